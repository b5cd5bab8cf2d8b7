"""Shapes of named definitions in device sources.

Fixed values: the patterns and word lists must equal what users of the index expect.
"""

# --- fixed values: headers of definitions with a body, group 1 is the name ------------------
RECORD = (
    r"(?md)^[ \t]*(?:template[ \t]*<[^>]*>[ \t]*)?(?:typedef[ \t]+)?"
    r"(?:struct|class|union|enum(?:[ \t]+class)?)[ \t]+([A-Za-z_]\w*)\b[^;{]*\{"
)
FUNCTION = (
    r"(?md)^[ \t]*(?:template[ \t]*<[^>]*>[ \t]*)?"
    r"(?:(?:static|inline|extern|__forceinline__|__device__|__host__|__global__|constexpr)[ \t]+)*"
    r"[A-Za-z_][\w:<>,*&\t ]*?\b([A-Za-z_]\w*)[ \t]*\([^;{]*\)[ \t]*(?:const[ \t]*)?\{"
)

# --- fixed values: definitions without a body ------------------------------------------------
MACRO = r"(?md)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)(?:[^\n]*\\\r?\n)*[^\n]*"
TYPEDEF = r"(?md)^[ \t]*typedef[ \t]+[^;{]*?\b([A-Za-z_]\w*)[ \t]*;"
USING = r"(?md)^[ \t]*using[ \t]+([A-Za-z_]\w*)[ \t]*=[ \t]*[^;]+;"
CONSTANT = (
    r"(?md)^[ \t]*(?:(?:static|extern|const|constexpr)[ \t]+)*(?:__constant__|__device__)[ \t]+"
    r"[\w:<>,*&\t ]+?\b([A-Za-z_]\w*)[ \t]*(?:\[[^\]]*\])?[ \t]*(?:=[^;]*)?;"
)

# --- fixed values: words that look like a function and are none ------------------------------
NOT_FUNCTIONS = (
    "if", "for", "while", "switch", "catch", "return", "else", "do", "sizeof",
    "static_cast", "reinterpret_cast", "const_cast", "dynamic_cast", "dim3", "case", "default", "operator",
)

# --- fixed values: words with a meaning in device functions only -----------------------------
DEVICE_WORDS = (
    "threadIdx", "blockIdx", "blockDim", "gridDim", "warpSize", "__syncthreads", "__shared__", "__shfl", "__ballot",
)
DEVICE_MARKS = ("__global__", "__device__")
KERNEL_MARK = "__global__"
