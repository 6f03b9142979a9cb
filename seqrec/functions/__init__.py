from seqrec.functions.exprs import (  # noqa: F401
    age_bucket, clamp, dot, epoch_micros, epoch_seconds, l2_norm, unit_vector,
)
