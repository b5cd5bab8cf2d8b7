"""Shapes of compiler diagnostics.

Fixed values: the patterns and tables must equal what users of the parser expect.
"""

# --- fixed values: a diagnostic line, and the message shapes in priority order ----------
DIAGNOSTIC_LINE = r"(?:^|\s)([^\s:]+):(\d+):(\d+):\s*(?:fatal\s+)?(error|warning):\s*(.*)$"
MESSAGE_PLACE = r"^[^:\n]+:\d+:\d+:\s*"
NOTE_LINE = r":\d+:\d+:\s*(?:note|remark):"

MISSING_HEADER = r"""['"]([^'"]+\.[Hh](?:pp|xx|h)?|[^'"]+\.cuh)['"] file not found"""
NO_MEMBER = r"""no member named ['"]?([A-Za-z_]\w*)['"]? in ['"]?([A-Za-z_][\w:<>]*)['"]?"""
UNDECLARED = (
    r"""use of undeclared identifier ['"]?([A-Za-z_]\w*)['"]?"""
    r"""(?:.*?;?\s*did you mean ['"]?([A-Za-z_]\w*)['"]?)?"""
)
UNKNOWN_TYPE = r"""unknown type name ['"]?([A-Za-z_]\w*)['"]?(?:.*?did you mean ['"]?([A-Za-z_:<>]+)['"]?)?"""
NO_TEMPLATE = r"""no template named ['"]?([A-Za-z_]\w*)['"]?"""
UNDEFINED_TEMPLATE = r"""implicit instantiation of undefined template ['"]([A-Za-z_][\w:]*)"""
NOT_A_TYPE = r"""['"]?([A-Za-z_]\w*)['"]? (?:does not name a type|was not declared in this scope)"""
NO_MATCHING = r"""no matching function for call to ['"]?([A-Za-z_]\w*)['"]?"""
ARG_COUNT = r"""(too few|too many) arguments to (?:function call|function ['"]?([A-Za-z_]\w*)['"]?)"""

# (kind, pattern, group of the symbol, group of the suggestion, group of the owner)
MESSAGE_SHAPES = (
    ("missing-include", MISSING_HEADER, 1, 0, 0),
    ("no-member", NO_MEMBER, 1, 0, 2),
    ("undeclared", UNDECLARED, 1, 2, 0),
    ("unknown-type", UNKNOWN_TYPE, 1, 2, 0),
    ("unknown-type", NO_TEMPLATE, 1, 0, 0),
    ("undefined-template", UNDEFINED_TEMPLATE, 1, 0, 0),
    ("unknown-type", NOT_A_TYPE, 1, 0, 0),
    ("no-matching-function", NO_MATCHING, 1, 0, 0),
    ("arg-count", ARG_COUNT, 2, 0, 0),
)

MISSING_MAIN = r"undefined (?:symbol|reference to)[\s\S]{0,10}\bmain\b"
LINKER_LINE = r"undefined (?:symbol|reference)|linker command failed|^\s*ld(?:\.lld)?\s*:"

# --- fixed values: tool log --------------------------------------------------------------
TOOL_MARKERS = ("unconverted", "warning:", "error:", "unable to")
TOOL_WARNING = r"(?i)(?:warning|error):\s*(.+?)(?:\s*\[(\d+)\])?$"

# --- fixed values: repair strategies -----------------------------------------------------
CONFIDENCE_SCORE = {"high": 0.9, "medium": 0.6, "low": 0.3}
STRATEGY_CONFIDENCE = {
    "insert-include": "high",
    "restore-macro": "high",
    "restore-type": "high",
    "restore-helper": "high",
    "restore-variable": "high",
    "restore-declaration": "high",
    "apply-compiler-rename": "high",
    "qualify-namespace": "high",
    "repair-signature": "medium",
    "relocate-scope": "medium",
    "replace-hip-intrinsic": "medium",
    "algorithm-rewrite": "low",
    "kernel-restructure": "low",
}
RESTORE_STRATEGY = {
    "macro": "restore-macro",
    "type": "restore-type",
    "helper": "restore-helper",
    "kernel": "restore-helper",
    "variable": "restore-variable",
}
STAGNATION_LIMIT = 4
PLATEAU_LIMIT = 2
CYCLE_REACH = 4
