"""Rating models: closed-form bias baseline and ALS factors."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.functions.exprs import clamp, dot
from seqrec.operators.innerproduct import top_products
from seqrec.operators.ordering import global_ordinal
from seqrec.operators.topk import topk_per_key
from seqrec.session import cut

PRED_DIGITS = 6
# Rating range of the clamped predictor.
MIN_RATING, MAX_RATING = 1.0, 5.0


def global_mean(train: DataFrame) -> Column:
    return train.select(F.avg("rating")).scalar()


def bias_baseline(train: DataFrame, item_damping: float = 25.0, user_damping: float = 10.0) -> dict:
    """Damped-mean biases: ``b_i = sum(r - mu) / (n_i + l_i)``, then
    ``b_u = sum(r - mu - b_i) / (n_u + l_u)``.  Returns ``mu`` (scalar
    column) and the ``item_bias`` / ``user_bias`` frames."""
    mu = global_mean(train)
    # sum(r - mu) = sum(r) - n * mu: the scalar stays outside the aggregate
    bi = (train.groupBy("item_id").agg(F.sum("rating").alias("_s"), F.count(F.lit(1)).alias("_n"))
          .select("item_id", ((F.col("_s") - F.col("_n") * mu) / (F.col("_n") + F.lit(item_damping))).alias("b_i")))
    bu = (train.join(bi, "item_id").groupBy("user_id")
          .agg(F.sum(F.col("rating") - F.col("b_i")).alias("_s"), F.count(F.lit(1)).alias("_n"))
          .select("user_id", ((F.col("_s") - F.col("_n") * mu) / (F.col("_n") + F.lit(user_damping))).alias("b_u")))
    return {"mu": mu, "item_bias": bi, "user_bias": bu}


def predict_clamped(events: DataFrame, model: dict, extra: Column | None = None) -> DataFrame:
    """``mu + b_u + b_i (+ extra)`` clamped to the rating range; an unknown
    user or item contributes nothing.  Adds ``prediction``."""
    j = events.join(model["user_bias"], "user_id", "left").join(model["item_bias"], "item_id", "left")
    raw = model["mu"] + F.coalesce("b_u", F.lit(0.0)) + F.coalesce("b_i", F.lit(0.0))
    if extra is not None:
        raw = raw + F.coalesce(extra, F.lit(0.0))
    return j.withColumn("prediction", F.round(clamp(raw, MIN_RATING, MAX_RATING), PRED_DIGITS)).drop("b_u", "b_i")


def _indexed(ids: DataFrame, col: str) -> DataFrame:
    """``(col, _i)``: a dense integer for every distinct id, whatever its size."""
    return cut(global_ordinal(ids.select(col).distinct(), [col], out="_i"), "ids").select(col, F.col("_i").cast("int").alias("_i"))


def train_factors(train: DataFrame, rank: int = 100, max_iter: int = 10, reg: float = 0.1,
                  seed: int = 339) -> dict:
    """The biased factor model: ``mu + b_u + b_i + p_u . q_i``.

    The biases are the damped means of ``bias_baseline``; ALS fits the factors to what they leave.  Ids may be any
    64-bit number.  Returns ``mu``, ``item_bias``, ``user_bias`` and the tables ``users`` / ``items``:
    ``(user_id | item_id, vec ARRAY<FLOAT>)``.
    """
    model = bias_baseline(train)
    model["item_bias"], model["user_bias"] = cut(model["item_bias"], "item-bias"), cut(model["user_bias"], "user-bias")
    users, items = _indexed(train, "user_id"), _indexed(train, "item_id")
    left = (train.join(model["user_bias"], "user_id").join(model["item_bias"], "item_id")
            .select("user_id", "item_id", (F.col("rating") - model["mu"] - F.col("b_u") - F.col("b_i")).alias("left")))
    data = (left.join(users.withColumnRenamed("_i", "_u"), "user_id").join(items, "item_id")
            .select("_u", "_i", F.col("left").cast("float").alias("left")))
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, userCol="_u", itemCol="_i", ratingCol="left",
              coldStartStrategy="nan", seed=seed, nonnegative=False).fit(data)
    vectors = lambda factors, ids, col: cut(factors.select(F.col("id").alias("_i"), F.col("features").alias("vec")).join(ids, "_i").select(col, "vec"), "factors")
    return model | {"users": vectors(als.userFactors, users, "user_id"), "items": vectors(als.itemFactors, items, "item_id")}


def factor_predictions(model: dict, events: DataFrame) -> DataFrame:
    """Clamped predictions for ``events``; an unknown user or item adds neither bias nor factors."""
    joined = (events.join(model["users"].withColumnRenamed("vec", "_p"), "user_id", "left")
              .join(model["items"].withColumnRenamed("vec", "_q"), "item_id", "left"))
    return predict_clamped(joined, model, extra=dot("_p", "_q")).drop("_p", "_q")


def recommend_factors(model: dict, train: DataFrame, test: DataFrame, ev_first: DataFrame, n: int = 5) -> DataFrame:
    """Top-``n`` unseen training-catalog items per test event of a training user.

    Items rank by ``b_i + p . q`` (mu and b_u are the same for all of a user's items); see ``innerproduct`` for the search.  What a user
    holds in training is seen at every test event; of the rest an event can rule out only what the user consumes in the test period,
    so a user needs the best ``n`` plus that many.  ``ev_first``: ``(user_id, item_id, first_key)`` with the struct
    ``(ts, event_id)`` of the first consumption.  Returns ``(event_id, user_id, item_id, score, rank)``.
    """
    tev = test.join(model["users"].select("user_id"), "user_id", "left_semi").select("event_id", "user_id", "ts")
    asking = tev.select("user_id").distinct()
    own = train.select("user_id", "item_id").distinct()
    held = own.join(asking, "user_id", "left_semi").groupBy("user_id").agg(F.collect_list("item_id").alias("seen"))
    later = (ev_first.join(own, ["user_id", "item_id"], "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("_c")))
    users = (model["users"].join(asking, "user_id").join(held, "user_id", "left").join(later, "user_id", "left")
             .select("user_id", "vec", (F.coalesce("_c", F.lit(0)) + n).alias("need"), "seen"))
    items = model["items"].join(model["item_bias"], "item_id").select("item_id", "vec", F.col("b_i").alias("bias"))
    cand = top_products(users, items)
    j = tev.join(cand, "user_id").join(ev_first, ["user_id", "item_id"], "left")
    seen = (F.col("first_key.ts") < F.col("ts")) | (
        (F.col("first_key.ts") == F.col("ts")) & (F.col("first_key.event_id") < F.col("event_id")))
    fresh = j.where(F.col("first_key").isNull() | ~seen)
    top = topk_per_key(fresh, "event_id", "item_id", "raw", n).join(model["user_bias"], "user_id", "left")
    score = F.round(clamp(model["mu"] + F.coalesce("b_u", F.lit(0.0)) + F.col("raw"), MIN_RATING, MAX_RATING), PRED_DIGITS)
    return top.select("event_id", "user_id", "item_id", score.alias("score"), "rank")
