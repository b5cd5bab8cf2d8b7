"""Line-kind tables for telling source text from prose.

The word lists are fixed values: they must equal what users of the gate expect.
"""

# --- fixed values: openings of a reasoning line ----------------------------------------
REASONING_LEADS = (
    r"Let(?:\s|')s\b", r"I\s+think\b", r"I\s+believe\b", r"I\s+will\b", r"I'll\b",
    r"I'm\s+going\s+to\b", r"Wait[,.\s]", r"Actually[,.\s]", r"Hmm[,.\s]", r"Okay[,.\s]",
    r"So\s+we\b", r"So\s+the\b", r"We\s+need\s+to\b", r"We\s+can\b", r"We\s+should\b",
    r"We\s+must\b", r"Need\s+to\b", r"Should\s+we\b", r"Maybe\b", r"Perhaps\b",
    r"Note\s+that\b", r"Notice\s+that\b", r"Here'?s\s+", r"Here\s+is\s+", r"This\s+means\b",
    r"The\s+idea\s+is\b", r"The\s+plan\s+is\b", r"Assistant[:\s]", r"User[:\s]",
    r"Reasoning[:\s]", r"Thought[:\s]", r"Thinking[:\s]",
)

# --- fixed values: section headings ----------------------------------------------------
HEADINGS = (
    "Explanation", "Summary", "Analysis", "Reasoning", "Thought", "Thinking", "Plan",
    "Approach", "Solution", "Answer", "Question", "Task", "Context", "Goal", "Objective",
    "Changes", "Rationale", "Notes?", "Background", "Overview", "Discussion", "Conclusion",
    "Steps?", "Output", "Input", "Response", "Assistant", "User",
)

# --- fixed values: line openings and character runs that mark source text ---------------
CODE_ANCHORS = (
    "#include", "#define", "#pragma", "#ifdef", "#ifndef", "#if ", "#endif", "#else",
    "#elif", "#undef", "__global__", "__device__", "__host__", "__shared__",
    "__constant__", "extern ", "static ", "inline ", "template", "namespace", "using ",
    "typedef ", "struct ", "class ", "enum ", "void ", "int ", "float ", "double ",
    "bool ", "char ", "unsigned ", "signed ", "return", "if ", "if(", "for ", "for(",
    "while ", "while(", "switch ", "switch(", "hip", "std::", "//", "/*", "*/", " * ",
)
CODE_MARKS = (
    "{", "}", ";", "->", "::", "==", "!=", "<=", ">=", "&&", "||", "<<", ">>", "++",
    "--", "+=", "-=", "*=", "/=",
)

# --- fixed values: shapes of prose lines -------------------------------------------------
REASONING = r"(?i)^\s*(?:" + "|".join(REASONING_LEADS) + ")"
SECTION_HEADING = r"(?i)^\s*(?:" + "|".join(HEADINGS) + r")\s*:\s*(?:$|[A-Z])"
MARKDOWN_HEADING = r"^\s*#{1,6}\s+[A-Za-z]"
MARKDOWN_FENCE = r"^\s*```"
BULLET = r"^\s*[-*]\s+[A-Za-z]"
NUMBERED = r"^\s*\d+\.\s+[A-Z][a-z]"
MARKDOWN_BOLD = r"^\s*\*\*[A-Za-z][^\n*]*\*\*\s*$"
ROLE_TAG = r"(?i)^\s*(?:assistant|user|system)\s*[:>|]"
TRAILING_ELLIPSIS = r"^[^/#\n]*\.\.\.\s*$"
SENTENCE = r"^[A-Z][a-z](?=.* )[^{};=()]*\.$"

# (category, pattern, on the stripped line?) — the first match names the line
PROSE_KINDS = (
    ("reasoning", REASONING, True),
    ("section-heading", SECTION_HEADING, True),
    ("markdown-heading", MARKDOWN_HEADING, False),
    ("bullet-list", BULLET, False),
    ("numbered-list", NUMBERED, False),
    ("role-tag", ROLE_TAG, False),
    ("prose-sentence", SENTENCE, True),
)

# --- fixed values: reject labels and their patterns
# (reason, pattern over the whole text) — the first match rejects the text
WHOLE_TEXT_REJECTS = (
    ("markdown code fence", "(?m)" + MARKDOWN_FENCE),
    ("markdown heading", "(?m)" + MARKDOWN_HEADING),
    ("role tag", "(?m)" + ROLE_TAG),
    ("trailing ellipsis", "(?m)" + TRAILING_ELLIPSIS),
    ("markdown bold", "(?m)" + MARKDOWN_BOLD),
)

# --- fixed values: marks of a cut text ---------------------------------------------------
TRUNCATION_MARK = (
    r"(?im)^\s*(?://\s*\.\.\.\s*(?:rest|remaining|truncated|omitted)|/\*\s*\.\.\.\s*\*/"
    r"|//\s*TRUNCATED|<!--\s*TRUNCATED|#\s*\.\.\.|\.\.\.\s*$)"
)

# --- fixed values: code-likeness of a block --------------------------------------------
SHAPE_STARTS = ("#include", "#define", "#pragma", "//", "/*", "*")
SHAPE_QUALIFIERS = ("__global__", "__device__", "__host__")
SHAPE_MARKS = ("{", "}", ";", "->", "::", "==", "!=", "<=", ">=")
SHAPE_BONUS = ("__global__", "__device__", "#include")
SHAPE_LEADS = r"(?i)^(?:Let'?s|I think|Wait|Actually|Here|So we|We need|Note that)"
SHAPE_SENTENCE = r"^[A-Z][a-z].{20,}\.\s*$"

# --- fixed values: extraction ----------------------------------------------------------
CODE_FIELDS = ("ported_code", "code", "hip_code", "source", "output", "port")
CODE_TAGS = ("", "cpp", "c++", "cxx", "c", "hip", "cuda", "cu", "hipcc", "opencl", "cl")
FENCE = r"(?s)```[ \t]*([A-Za-z0-9_+#\-]*)[ \t]*\r?\n(.*?)```"
JSON_FENCE = r"(?si)```[ \t]*json[ \t]*\r?\n(.*?)```"
WINDOW_ANCHOR = (
    r'#include|#define|#pragma|#ifdef|#ifndef|__global__|__device__|__host__|__shared__'
    r'|__constant__|extern\s+"C"|template\s*<|namespace\s+\w'
)
WINDOW_QUALIFIERS = ("__global__", "__device__", "__host__", "__shared__", "__constant__")
WINDOW_MARKS = ("{", "}", ";", "->", "::")
