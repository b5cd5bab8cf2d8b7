"""Rubric tables.  Points and thresholds are fixed values users of the scores expect."""

from rivulant.rules import Term


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _count(column: str, words) -> str:
    return "(" + " + ".join(f"int(contains({column}, '{w}'))" for w in words) + ")"


# --- fixed values: API names -------------------------------------------------------------
RUN_APIS = (
    "hipMalloc", "hipFree", "hipMemcpy", "hipLaunchKernel", "hip/hip_runtime.h",
    "hipThreadIdx", "hipBlockIdx", "hipBlockDim", "hipStreamSynchronize",
)
RUN_LEFTOVERS = ("cudaMalloc", "cudaFree", "cudaMemcpy", "cuda_runtime.h", "cudaDeviceSynchronize")
RESPONSE_APIS = (
    "hipMalloc", "hipFree", "hipMemcpy", "hip/hip_runtime.h", "hipLaunchKernel", "__global__",
)
RESPONSE_LEFTOVERS = ("cudaMalloc", "cudaFree", "cudaMemcpy", "cuda_runtime.h")


def run_rubric(apis=RUN_APIS, leftovers=RUN_LEFTOVERS, code: str = "code") -> tuple[Term, ...]:
    """F15a.  Needs coder_ok, evaluator_ok, verifier_ok, passed and the text."""
    long = f"length(trim({code})) > 50"
    return (
        Term("coder", "coder_ok", 12),
        Term("evaluator", "evaluator_ok", 18),
        Term("verifier", "verifier_ok", 5),
        Term("length", long, 10),
        Term("apis", f"{long} AND {_count(code, apis)} >= 3", 15),
        Term("apis", f"{long} AND {_count(code, apis)} >= 1", 8),
        Term("leftovers", f"{long} AND {_count(code, leftovers)} = 0", 10),
        Term("leftovers", f"{long} AND {_count(code, leftovers)} <= 2", 3),
        Term("outcome", "passed", 30),
        Term("outcome", "verifier_ok", 10),
    )


# --- fixed values: words that show what a change was about --------------------------------
CHANGE_CATEGORIES = (
    ("wavefront",),
    ("mask", "0x3f", "0x1f"),
    ("shfl", "shuffle"),
    ("sync",),
    ("tile",),
    ("shared",),
    ("lane",),
    ("ballot", "activemask"),
    ("all_sync", "any_sync", "match_all"),
    ("warp_size", "warp_mask"),
    ("cached", "verified"),
)


def port_rubric(categories=CHANGE_CATEGORIES) -> tuple[Term, ...]:
    """F15b.  Needs source, code, changes (array of texts), cached.  The `portability` group is capped at 35."""
    said = "exists(changes, c -> {})"
    no_change = said.format("contains(lower(c), 'no automatic changes needed')")
    terms = [
        Term("header", "contains(code, '#define WAVEFRONT_SIZE 64')", 20),
        Term("header", "contains(code, 'WAVEFRONT_SIZE')", 12),
        Term("portability", no_change, 35),
        Term("portability", f"NOT {no_change}", 15),
    ]
    for words in categories:
        hit = said.format(_any("lower(c)", words))
        terms.append(Term("portability", f"NOT {no_change} AND {hit}", 5))
    n = "length(trim(code))"
    terms += [
        Term("length0", f"{n} > 0", 5),
        Term("length50", f"{n} > 50", 5),
        Term("length200", f"{n} > 200", 5),
        Term("shape", "contains(code, '__global__') OR contains(code, '__device__')", 10),
        Term("shape", "contains(code, 'void') AND contains(code, '(') AND contains(code, ')')", 5),
        Term("half", f"length(source) > 0 AND {n} >= length(trim(source)) * 0.5", 5),
        Term("log1", "size(changes) >= 1", 5),
        Term("log3", "size(changes) >= 3", 5),
        Term("log5", "size(changes) >= 5", 5),
        Term("log8", "size(changes) >= 8", 5),
        Term("cached", "cached", 5),
    ]
    return tuple(terms)


PORT_CAPS = {"portability": 35.0}

# F15c.  Needs code.
EXTRACTED_RUBRIC = (
    Term("some", "length(trim(code)) > 0", 10),
    Term("length", "length(code) > 50", 15),
    Term("qualifier", "contains(code, '__global__') OR contains(code, '__device__')", 25),
    Term("qualifier", r"contains(code, 'void') AND rlike(code, r'\w+\s*\(')", 10),
    Term("include", r"rlike(code, r'#include\s*<')", 10),
    Term("braces", r"rlike(code, r'\{[^}]*\}')", 5),
    Term("signature", r"rlike(code, r'__global__\s+void\s+\w+\s*\(')", 15),
    Term("index", "rlike(code, 'threadIdx|blockIdx|blockDim')", 10),
    Term("storage", "rlike(code, '__shared__|__device__|__constant__')", 10),
)


def response_rubric(apis=RESPONSE_APIS, leftovers=RESPONSE_LEFTOVERS, text: str = "response") -> tuple[Term, ...]:
    """F15d, capped at 1.  Needs the response text."""
    said = rf"rlike({text}, r'\S')"
    return (
        Term("some", said, 0.3),
        Term("length", f"{said} AND length({text}) > 100", 0.1),
        Term("apis", f"{said} AND {_any(text, apis)}", 0.15),
        Term("fence", rf"{said} AND rlike({text}, r'```(?:cuda|hip|cpp)?\n')", 0.15),
        Term("braces", rf"{said} AND rlike({text}, r'\{{[^}}]*\}}')", 0.15),
        Term("clean", f"{said} AND NOT {_any(text, leftovers)}", 0.15),
    )
