"""Column expressions (JVM-side, codegen-friendly) shared by the operators."""

from articleflow.functions.exprs import (  # noqa: F401
    BREAKER_STATE_TEXT,
    UP_TEXT,
    anchored_match,
    code_text,
    content_hash,
    elapsed_seconds,
    epoch_ms_to_ts,
    epoch_us,
    rfc3339,
    str0,
    truncate_ellipsis,
)
