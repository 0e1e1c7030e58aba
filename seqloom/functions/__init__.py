"""Column-expression helpers (JVM-side, codegen-friendly)."""

from seqloom.functions.hashing import hash_int, hash_unit  # noqa: F401
from seqloom.functions.text import (  # noqa: F401
    PY_WHITESPACE_CLASS,
    single_space_tokens,
    whitespace_tokens,
    token_count_single_space,
)
