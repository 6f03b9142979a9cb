from seqrec.sources.ratings import (  # noqa: F401
    RATINGS_SCHEMA, events_ratings, lineitem_ratings, read_ratings, write_ratings,
)
