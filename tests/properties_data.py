"""Random rating logs shared by the property and streaming tests."""

import random
from collections import defaultdict


def random_log(seed, users=6, items=12, n=240, max_gap=30):
    rnd = random.Random(seed)
    t = defaultdict(int)
    rows = []
    for k in range(n):
        u = rnd.randrange(users)
        t[u] += rnd.choice([0, 1, 2, 3, 5, 8, 13, 40, max_gap])
        rows.append({"user_id": u, "item_id": rnd.randrange(items), "rating": 3.0, "ts": 1000 + t[u] + k,
                     "event_id": k})
    return rows


def random_log_df(spark, seed, **kw):
    rows = random_log(seed, **kw)
    return spark.createDataFrame([(r["user_id"], r["item_id"], r["rating"], r["ts"], r["event_id"]) for r in rows],
                                 "user_id bigint, item_id bigint, rating double, ts bigint, event_id bigint")
