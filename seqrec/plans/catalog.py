"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables through a ratings view (E from
``events``, L from ``orders`` + ``lineitem``) and runs over all of it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.operators import blocks as B
from seqrec.operators import decay as DC
from seqrec.operators import embeddings as EM
from seqrec.operators import evaluate as EV
from seqrec.operators import incremental as INC
from seqrec.operators import jointfactors as JF
from seqrec.operators import models as MD
from seqrec.operators import neighbors as NB
from seqrec.operators import ordering as O
from seqrec.operators import profiles as PR
from seqrec.operators import recommend as R
from seqrec.operators import sessions as SE
from seqrec.operators import setops as SO
from seqrec.operators import similarity as S
from seqrec.operators import splits as SP
from seqrec.operators import topk as T
from seqrec.operators import vectors as VE
from seqrec.plans import embedding_based as EB
from seqrec.plans import implicit_knn as IK
from seqrec.plans import item_based as IB
from seqrec.plans import params as P
from seqrec.plans import user_based as UB
from seqrec.session import cut, scratch_path
from seqrec.sources import sessions_io as SIO
from seqrec.sources.ratings import events_ratings, lineitem_ratings, read_ratings, write_ratings
from seqrec.sources.vectors import embeddings_table, load_embeddings, save_embeddings
from seqrec.streaming import sessions as STS
from seqrec.streaming import similarity as STR

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- shared views

def _split_e(spark, sf):
    # typed + split once per plan; every branch reads this small columnar copy
    return cut(SP.holdout_last_n(events_ratings(spark, sf), test_pct=P.TEST_PCT), "split-e")


def _train_test_e(spark, sf):
    s = _split_e(spark, sf)
    return SP.train_part(s).drop("is_test"), SP.test_part(s).drop("is_test")


ITEM_PARAMS = IB.ItemBasedParams(gap=P.GAP_E, k=P.K_ITEM, n=P.N_RECS, test_n=None, test_pct=P.TEST_PCT)


def _item_network_e(train):
    return IB.item_network(train, ITEM_PARAMS)


# ---------------------------------------------------------------- profiles / order

@query("typed_ratings")
def q_typed_ratings(spark, sf):
    return events_ratings(spark, sf)


@query("event_order")
def q_event_order(spark, sf):
    return O.event_order(events_ratings(spark, sf))


@query("holdout_last_n")
def q_holdout_last_n(spark, sf):
    return _split_e(spark, sf)


@query("holdout_last_n_skip_first")
def q_holdout_last_n_skip_first(spark, sf):
    return SP.holdout_last_n(events_ratings(spark, sf), test_pct=P.TEST_PCT, skip_first=True)


@query("holdout_by_time")
def q_holdout_by_time(spark, sf):
    return SP.holdout_by_time(events_ratings(spark, sf), test_pct=P.TEST_PCT)


def PR_known(test, train):
    return test.join(train.select("user_id"), "user_id", "left_semi")


# ---------------------------------------------------------------- item-based

@query("consumption_blocks")
def q_consumption_blocks(spark, sf):
    train, _ = _train_test_e(spark, sf)
    return B.consumption_blocks(train, P.GAP_E).select(
        "user_id", "block_id", "n", "idx", "item_id", "ts", "event_id")


@query("block_item_similarity")
def q_block_item_similarity(spark, sf):
    train, _ = _train_test_e(spark, sf)
    return S.block_item_similarity(train, P.GAP_E)


@query("topk_item_neighbors")
def q_topk_item_neighbors(spark, sf):
    train, _ = _train_test_e(spark, sf)
    return _item_network_e(train)


@query("recommend_item_neighbors")
def q_recommend_item_neighbors(spark, sf):
    train, test = _train_test_e(spark, sf)
    return R.recommend_item_neighbors(train, test, _item_network_e(train), P.N_RECS)


@query("precision_recall")
def q_precision_recall(spark, sf):
    train, test = _train_test_e(spark, sf)
    recs = R.recommend_item_neighbors(train, test, _item_network_e(train), P.N_RECS)
    return EV.precision_recall(recs, PR_known(test, train), population=test)


# ---------------------------------------------------------------- profiles, filters


@query("user_profiles")
def q_user_profiles(spark, sf):
    return PR.user_profiles(events_ratings(spark, sf))


@query("profile_positions")
def q_profile_positions(spark, sf):
    return PR.profile_positions(events_ratings(spark, sf))


@query("profile_map")
def q_profile_map(spark, sf):
    return PR.profile_map(events_ratings(spark, sf))


@query("active_users")
def q_active_users(spark, sf):
    return PR.active_users(events_ratings(spark, sf), P.MIN_SESSION_ITEMS)


@query("known_users")
def q_known_users(spark, sf):
    train, test = _train_test_e(spark, sf)
    return PR.known_users(test, train)


@query("unknown_users")
def q_unknown_users(spark, sf):
    train, test = _train_test_e(spark, sf)
    return PR.unknown_users(test, train)


@query("item_catalog")
def q_item_catalog(spark, sf):
    return PR.item_catalog(events_ratings(spark, sf))


@query("recent_items")
def q_recent_items(spark, sf):
    split = _split_e(spark, sf)
    train = SP.train_part(split)
    known = split.join(train.select("user_id").distinct(), "user_id", "left_semi")
    return PR.recent_items(known, F.col("is_test"), P.EMB_RECENT)


@query("sample_items")
def q_sample_items(spark, sf):
    train, _ = _train_test_e(spark, sf)
    return PR.sample_items(train, 5, seed=7)


@query("ratings_summary")
def q_ratings_summary(spark, sf):
    return PR.ratings_summary(_split_e(spark, sf))


@query("profile_intersect")
def q_profile_intersect(spark, sf):
    train, test = _train_test_e(spark, sf)
    return SO.profile_intersect(train, test)


@query("profile_union")
def q_profile_union(spark, sf):
    train, test = _train_test_e(spark, sf)
    return SO.profile_union(train, test)


@query("profile_difference")
def q_profile_difference(spark, sf):
    train, test = _train_test_e(spark, sf)
    return SO.profile_difference(test, train)


# ---------------------------------------------------------------- sessions

def _sessions_e(spark, sf):
    return SE.user_sessions(events_ratings(spark, sf), P.SESSION_GAP_E, P.MIN_SESSION_ITEMS)


@query("user_sessions")
def q_user_sessions(spark, sf):
    return _sessions_e(spark, sf)


@query("gap_sessions")
def q_gap_sessions(spark, sf):
    return B.gap_sessions(events_ratings(spark, sf), P.GAP_E).select("user_id", "session_id", "n", "item_id", "ts", "event_id")


@query("session_corpus")
def q_session_corpus(spark, sf):
    corpus = SE.session_corpus(_sessions_e(spark, sf))
    return corpus.select("user_id", "session_id", F.posexplode("tokens").alias("n", "token")).withColumn("n", F.col("n").cast("bigint"))


@query("session_sentences")
def q_session_sentences(spark, sf):
    return SE.session_sentences(_sessions_e(spark, sf))


@query("session_lines")
def q_session_lines(spark, sf):
    return SIO.session_lines(_sessions_e(spark, sf))


@query("session_roundtrip")
def q_session_roundtrip(spark, sf):
    path = scratch_path(spark, "sessions")
    SIO.write_sessions(_sessions_e(spark, sf), path)
    back = SIO.read_sessions(spark, path)
    return back.select(F.col("user_id").cast("bigint").alias("user_id"),
                       F.array_join("tokens", " ").alias("sentence"))


# ---------------------------------------------------------------- text sources

def _roundtrip(spark, sf, fmt):
    e = events_ratings(spark, sf)
    if fmt == "priced_tsv":
        ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("value").alias("price"))
        e = e.join(ev, "event_id")
    path = scratch_path(spark, f"ratings-{fmt}")
    # part files in replay order, so that reading numbers the events as before
    write_ratings(e.repartitionByRange("event_id").sortWithinPartitions("event_id"), path, fmt)
    return read_ratings(spark, path, fmt, keep_price=(fmt == "priced_tsv"))


@query("scan_tsv")
def q_scan_tsv(spark, sf):
    return _roundtrip(spark, sf, "tsv")


@query("scan_double_colon")
def q_scan_double_colon(spark, sf):
    return _roundtrip(spark, sf, "double_colon")


@query("scan_csv")
def q_scan_csv(spark, sf):
    return _roundtrip(spark, sf, "csv")


@query("scan_priced")
def q_scan_priced(spark, sf):
    return _roundtrip(spark, sf, "priced_tsv")


# ---------------------------------------------------------------- user-based


UB_PARAMS = UB.UserBasedParams(delta=P.DELTA, k=P.K_USER, n=P.N_RECS, test_n=None, test_pct=P.TEST_PCT,
                               every=None, every_pct=P.REFRESH_PCT)


def _train_positions_e(spark, sf):
    train, _ = _train_test_e(spark, sf)
    return O.order_events(train)


@query("seq_user_similarity")
def q_seq_user_similarity(spark, sf):
    return S.seq_user_similarity(_train_positions_e(spark, sf), P.DELTA)


@query("topk_user_neighbors")
def q_topk_user_neighbors(spark, sf):
    train = _train_positions_e(spark, sf)
    return NB.padded_lists(S.seq_user_neighbors(train, P.DELTA, P.K_USER), train, P.K_USER)


@query("merge_similarity")
def q_merge_similarity(spark, sf):
    ev, t0, total = UB._split(events_ratings(spark, sf), UB_PARAMS)
    trip = S.sequence_triples(S.first_occurrences(ev), P.DELTA)
    counts = cut(S.pair_counts(trip, t0), "pair-counts")
    old = counts.where("before > 0").select("user_a", "user_b", F.col("before").alias("score"))
    new = counts.where("after > before").select("user_a", "user_b", (F.col("after") - F.col("before")).alias("score"))
    return S.mirror(S.merge_similarity(old, new))


@query("versioned_similarity")
def q_versioned_similarity(spark, sf):
    ev, t0, total = UB._split(events_ratings(spark, sf), UB_PARAMS)
    return INC.versioned_similarity(ev, t0, total, P.DELTA, UB.refresh_period(total, UB_PARAMS))


@query("similarity_intervals")
def q_similarity_intervals(spark, sf):
    ev, t0, total = UB._split(events_ratings(spark, sf), UB_PARAMS)
    return INC.similarity_intervals(ev, t0, total, P.DELTA, UB.refresh_period(total, UB_PARAMS))


@query("delta_profiles")
def q_delta_profiles(spark, sf):
    ev, t0, total = UB._split(events_ratings(spark, sf), UB_PARAMS)
    return INC.delta_profiles(ev, t0, UB.refresh_period(total, UB_PARAMS)).select(
        "user_id", "item_id", "ts", "event_id", "ord", "version")


def _user_based_e(spark, sf):
    return UB.user_based(events_ratings(spark, sf), UB_PARAMS)


@query("network_as_of")
def q_network_as_of(spark, sf):
    return _user_based_e(spark, sf)["served"].select("event_id", "user_id", "sv", "bstar")


@query("recommend_user_neighbors")
def q_recommend_user_neighbors(spark, sf):
    return _user_based_e(spark, sf)["recs"]


@query("rec_sets")
def q_rec_sets(spark, sf):
    return _user_based_e(spark, sf)["recs"].select("user_id", "item_id").distinct()


@query("precision_recall_user")
def q_precision_recall_user(spark, sf):
    return _user_based_e(spark, sf)["metrics"]


@query("unknown_users_network")
def q_unknown_users_network(spark, sf):
    return _user_based_e(spark, sf)["cold"]


# ---------------------------------------------------------------- implicit kNN


IK_PARAMS = IK.ImplicitParams(k=P.K_IMPLICIT, n=P.N_RECS, test_n=None, test_pct=P.TEST_PCT,
                              day_units=P.DAY_E, phase_days=P.PHASE_DAYS_E)


def _time_split_e(spark, sf):
    e = events_ratings(spark, sf)
    t0 = SP.time_boundary(e, test_pct=P.TEST_PCT)
    s = cut(e.withColumn("is_test", F.col("ts") >= t0), "time-split-e")
    return e, t0, s.where(~F.col("is_test")).drop("is_test"), s.where(F.col("is_test")).drop("is_test")


@query("item_launch_time")
def q_item_launch_time(spark, sf):
    _, _, train, _ = _time_split_e(spark, sf)
    return DC.item_launch_time(train)


@query("age_buckets")
def q_age_buckets(spark, sf):
    _, t0, train, _ = _time_split_e(spark, sf)
    return DC.age_buckets(train, t0, P.DAY_E, P.PHASE_DAYS_E).select("event_id", "user_id", "item_id", "i", "j")


@query("pseudo_ratings")
def q_pseudo_ratings(spark, sf):
    _, t0, train, _ = _time_split_e(spark, sf)
    return DC.pseudo_ratings(train, t0, P.DAY_E, P.PHASE_DAYS_E)


@query("cosine_user_knn")
def q_cosine_user_knn(spark, sf):
    _, t0, train, _ = _time_split_e(spark, sf)
    return IK.knn_network(train, t0, IK_PARAMS)


@query("jaccard_user_knn")
def q_jaccard_user_knn(spark, sf):
    from dataclasses import replace
    _, t0, train, _ = _time_split_e(spark, sf)
    return IK.knn_network(train, t0, replace(IK_PARAMS, measure="jaccard"))


@query("recommend_implicit_knn")
def q_recommend_implicit_knn(spark, sf):
    return IK.implicit_knn(events_ratings(spark, sf), IK_PARAMS)["recs"]


@query("precision_recall_multiset")
def q_precision_recall_multiset(spark, sf):
    out = IK.implicit_knn(events_ratings(spark, sf), IK_PARAMS)
    truth = out["test"].join(out["train"].select("user_id"), "user_id", "left_semi")
    return EV.precision_recall_multiset(out["recs"], truth)


# ---------------------------------------------------------------- embeddings


def _emb_inputs(spark, sf):
    """The vectors, and the vocabulary of the training sessions by frequency (items without a vector are not in it)."""
    vec = embeddings_table(spark, sf)
    split = SP.holdout_last_n(events_ratings(spark, sf), test_pct=P.TEST_PCT, skip_first=True)
    sessions = SE.user_sessions(SP.train_part(split).drop("is_test"), P.SESSION_GAP_E, P.MIN_SESSION_ITEMS)
    known = sessions.select("item_id").join(vec.select("item_id"), "item_id", "left_semi")
    return vec, cut(VE.vocab_ranks(known), "vocabulary")


def _emb_e(spark, sf):
    vec, ranks = _emb_inputs(spark, sf)
    return EB.recommend_embeddings(events_ratings(spark, sf), vec, ranks, n=P.N_EMB, test_n=None,
                                   test_pct=P.TEST_PCT, recent=P.EMB_RECENT, topn=P.EMB_TOPN)


@query("normalize_vectors")
def q_normalize_vectors(spark, sf):
    return VE.vectors_long(VE.normalize_vectors(embeddings_table(spark, sf)))


@query("vocab_ranks")
def q_vocab_ranks(spark, sf):
    return VE.vocab_ranks(_sessions_e(spark, sf).select("item_id"))


@query("most_similar")
def q_most_similar(spark, sf):
    return _emb_e(spark, sf)["candidates"]


@query("recommend_embeddings")
def q_recommend_embeddings(spark, sf):
    return _emb_e(spark, sf)["recs"]


@query("precision_recall_embeddings")
def q_precision_recall_embeddings(spark, sf):
    out = _emb_e(spark, sf)
    return EV.precision_recall(out["recs"], out["targets"], population=out["test"])


# ---------------------------------------------------------------- models


SKIP_GRAM = EM.SkipGram(size=200, window=3, negatives=4, epochs=1, seed=339)


def _bias_e(spark, sf):
    train, test = _train_test_e(spark, sf)
    return train, test, MD.bias_baseline(train)


@query("bias_baseline")
def q_bias_baseline(spark, sf):
    _, _, m = _bias_e(spark, sf)
    items = m["item_bias"].select(F.lit("item").alias("kind"), F.col("item_id").alias("id"),
                                  F.round("b_i", 6).alias("bias"))
    users = m["user_bias"].select(F.lit("user").alias("kind"), F.col("user_id").alias("id"),
                                  F.round("b_u", 6).alias("bias"))
    return items.unionByName(users)


@query("predict_clamped")
def q_predict_clamped(spark, sf):
    _, test, m = _bias_e(spark, sf)
    return MD.predict_clamped(test, m).select("event_id", "user_id", "item_id", "rating", "prediction")


@query("mae_baseline")
def q_mae_baseline(spark, sf):
    _, test, m = _bias_e(spark, sf)
    return EV.mae(MD.predict_clamped(test, m))


def _factors_e(spark, sf):
    train, test = _train_test_e(spark, sf)
    return train, test, JF.train_joint_factors(train, JF.JointFactors(rank=P.FACTORS))


@query("rated_pairs")
def q_rated_pairs(spark, sf):
    """What the factors learn from: every pair of the training split once, with the number and the sum of its ratings."""
    return JF.rated_pairs(_train_test_e(spark, sf)[0]).withColumn("total", F.round("total", 6))


@query("train_factors")
def q_train_factors(spark, sf):
    _, test, model = _factors_e(spark, sf)
    return MD.factor_predictions(model, test).select("event_id", "user_id", "item_id", "rating", "prediction")


@query("mae_factors")
def q_mae_factors(spark, sf):
    _, test, model = _factors_e(spark, sf)
    return EV.mae(MD.factor_predictions(model, test))


@query("factors_against_baseline")
def q_factors_against_baseline(spark, sf):
    """What must hold of the fitted factors whatever the optimiser does: every test event predicted inside the rating range, and no worse than the biases alone."""
    train, test, model = _factors_e(spark, sf)
    pred = cut(MD.factor_predictions(model, test), "predictions")
    base = EV.mae(MD.predict_clamped(test, MD.bias_baseline(train))).first()["mae"]
    inside = F.coalesce(F.every(F.col("prediction").between(MD.MIN_RATING, MD.MAX_RATING)), F.lit(False))
    return pred.agg(F.count(F.lit(1)).alias("events"), inside.alias("inside"), (F.avg(F.abs(F.col("prediction") - F.col("rating"))) <= base * 1.05).alias("close_to_baseline"))


def _factor_recs(spark, sf):
    train, test, model = _factors_e(spark, sf)
    first = (train.unionByName(test).groupBy("user_id", "item_id")
             .agg(F.min(F.struct("ts", "event_id")).alias("first_key")))
    return train, test, MD.recommend_factors(model, train, test, first, n=P.N_EMB)


@query("recommend_factors")
def q_recommend_factors(spark, sf):
    return _factor_recs(spark, sf)[2]


@query("precision_recall_factors")
def q_precision_recall_factors(spark, sf):
    train, test, recs = _factor_recs(spark, sf)
    return EV.precision_recall(recs, PR_known(test, train), population=test)


def _sentences(ratings):
    return SE.session_corpus(SE.user_sessions(ratings, P.SESSION_GAP_E, P.MIN_SESSION_ITEMS))


def _trained(spark, sf):
    """Vectors of the training sessions, and these sessions."""
    corpus = cut(_sentences(_train_test_e(spark, sf)[0]))
    return EM.item_vectors(EM.train_skip_gram(corpus, SKIP_GRAM)), corpus


@query("item_embeddings")
def q_item_embeddings(spark, sf):
    return _trained(spark, sf)[0]


@query("embedding_store")
def q_embedding_store(spark, sf):
    path = scratch_path(spark, "vectors")
    save_embeddings(embeddings_table(spark, sf), path)
    return VE.vectors_long(load_embeddings(spark, path))


@query("item_embeddings_vocabulary")
def q_item_embeddings_vocabulary(spark, sf):
    """What must hold of the trained vectors whatever the optimiser does: one of the asked size for every item of the corpus."""
    return _trained(spark, sf)[0].select("item_id", F.size("vector").cast("bigint").alias("dims"), F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)).alias("finite"))


def _model_of_two_batches(spark, sf):
    """A stored model of the training sessions, trained further with the sessions of the test period."""
    train, test = _train_test_e(spark, sf)
    path = scratch_path(spark, "embedding-model")
    EM.extend_model(cut(_sentences(train)), path, SKIP_GRAM)
    EM.extend_model(cut(_sentences(test)), path, SKIP_GRAM)
    return EM.load_model(spark, path)


@query("retrain_embeddings")
def q_retrain_embeddings(spark, sf):
    return EM.item_vectors(_model_of_two_batches(spark, sf))


@query("retrained_vocabulary")
def q_retrained_vocabulary(spark, sf):
    """What must hold of a model of two batches whatever its draws: every word of either with its count in both, and a finite vector."""
    finite = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x))
    return _model_of_two_batches(spark, sf).select(F.col("word").cast("bigint").alias("item_id"), "n", F.size("center").cast("bigint").alias("dims"),
                                                   (finite("center") & finite("context")).alias("finite"))


@query("skip_gram_pairs")
def q_skip_gram_pairs(spark, sf):
    """Pairs of neighbouring items in the training sessions, as the trainer counts them with a window of one."""
    pairs = EM.skip_pairs(_sentences(_train_test_e(spark, sf)[0]), 1, SKIP_GRAM.seed)
    return pairs.select(F.col("center").cast("bigint").alias("center"), F.col("context").cast("bigint").alias("context"), "n")


@query("recommend_embeddings_trained")
def q_recommend_embeddings_trained(spark, sf):
    vec, corpus = _trained(spark, sf)
    ranks = VE.vocab_ranks(corpus.select(F.explode("tokens").alias("t")).select(F.col("t").cast("bigint").alias("item_id")))
    out = EB.recommend_embeddings(events_ratings(spark, sf), cut(vec), ranks, n=P.N_EMB, test_n=None,
                                  test_pct=P.TEST_PCT, recent=P.EMB_RECENT, topn=P.EMB_TOPN)
    return out["recs"]


# ---------------------------------------------------------------- counters

@query("run_counters")
def q_run_counters(spark, sf):
    train, test = _train_test_e(spark, sf)
    recs = R.recommend_item_neighbors(train, test, _item_network_e(train), P.N_RECS)
    pr = EV.precision_recall(recs, PR_known(test, train), population=test)
    scored = PR_known(test, train).select(F.count(F.lit(1)).cast("bigint")).scalar()
    every = train.unionByName(test)
    users = every.select(F.count_distinct("user_id").cast("bigint")).scalar()
    items = every.select(F.count_distinct("item_id").cast("bigint")).scalar()
    return pr.select(F.col("users").alias("pr_users"), "norec", scored.alias("scored_events"),
                     users.alias("users"), items.alias("items"))


@query("run_counters_user")
def q_run_counters_user(spark, sf):
    out = _user_based_e(spark, sf)
    scored = out["served"].where(F.col("bstar").isNotNull()).select(F.count(F.lit(1)).cast("bigint")).scalar()
    cold = out["cold"]
    return out["metrics"].select(F.col("users").alias("pr_users"), "norec", scored.alias("scored_events"),
                                 cold.select("cold_events").scalar().alias("cold_events"), cold.select("cold_users").scalar().alias("cold_users"))


@query("run_counters_implicit")
def q_run_counters_implicit(spark, sf):
    out = IK.implicit_knn(events_ratings(spark, sf), IK_PARAMS)
    recs = cut(out["recs"], "recs")
    known = out["test"].join(out["train"].select("user_id"), "user_id", "left_semi")
    return recs.agg(F.count_distinct("user_id").cast("bigint").alias("users_with_recs"), F.count_distinct("event_id").cast("bigint").alias("events_with_recs"),
                    F.count(F.lit(1)).cast("bigint").alias("recs")).withColumn("scored_events", known.select(F.count(F.lit(1)).cast("bigint")).scalar())


@query("run_counters_embeddings")
def q_run_counters_embeddings(spark, sf):
    out = _emb_e(spark, sf)
    metrics = EV.precision_recall(out["recs"], out["targets"], population=out["test"])
    return metrics.select(F.col("users").alias("pr_users"), "norec", out["targets"].select(F.count(F.lit(1)).cast("bigint")).scalar().alias("scored_events"))


# ---------------------------------------------------------------- streaming


STREAM_CHUNKS = 4


def _staged(spark, sf, which):
    train, _ = _train_test_e(spark, sf)
    src = train if which == "train" else events_ratings(spark, sf)
    return STR.stage_chunks(src, scratch_path(spark, f"stream-src-{which}"), STREAM_CHUNKS)


@query("stream_blocks")
def q_stream_blocks(spark, sf):
    blocks = STR.run_stream_blocks(spark, _staged(spark, sf, "train"), P.GAP_E)
    return blocks.select("user_id", "block_id", "n", "idx", "item_id", "ts", "event_id")


@query("stream_item_similarity")
def q_stream_item_similarity(spark, sf):
    return STR.run_stream_item_similarity(spark, _staged(spark, sf, "train"), P.GAP_E)


@query("stream_sessions")
def q_stream_sessions(spark, sf):
    return STS.run_stream_sessions(spark, _staged(spark, sf, "all"), P.GAP_E)


@query("stream_user_similarity")
def q_stream_user_similarity(spark, sf):
    return STR.run_stream_user_similarity(spark, _staged(spark, sf, "all"), P.DELTA)


# ---------------------------------------------------------------- remaining inventory keys

@query("exclude_seen")
def q_exclude_seen(spark, sf):
    train, test = _train_test_e(spark, sf)
    return R.item_neighbor_votes(train, test, _item_network_e(train), exclude_seen=True)


@query("candidate_widening")
def q_candidate_widening(spark, sf):
    vec, ranks = _emb_inputs(spark, sf)
    out = _emb_e(spark, sf)
    pos = PR.recent_items(out["train"].unionByName(out["test"]).join(out["train"].select("user_id").distinct(),
                                                                   "user_id", "left_semi"),
                          out["targets"], P.EMB_RECENT).select("event_id", "item_id")
    q = VE.query_vectors(pos, VE.normalize_vectors(vec), ranks)
    size = ranks.select(F.count(F.lit(1)).cast("bigint")).scalar()
    return q.select("event_id", VE.candidate_vocab_size(F.col("pos_ranks"), size).alias("r"))


# ---------------------------------------------------------------- view L (orders x lineitem)


@query("typed_ratings_orders")
def q_typed_ratings_orders(spark, sf):
    return lineitem_ratings(spark, sf)


@query("recommend_item_neighbors_orders")
def q_recommend_item_neighbors_orders(spark, sf):
    split = cut(SP.holdout_last_n(lineitem_ratings(spark, sf), test_pct=P.TEST_PCT), "split-l")
    train, test = SP.train_part(split).drop("is_test"), SP.test_part(split).drop("is_test")
    sim = S.block_item_similarity(train, P.GAP_L)
    net = T.topk_neighbors(sim, P.K_ITEM, src="src_item", dst="dst_item").select(
        F.col("src_item").alias("src"), F.col("dst_item").alias("dst"), "score", "rank")
    return R.recommend_item_neighbors(train, test, net, P.N_RECS)


@query("metrics_roundtrip")
def q_metrics_roundtrip(spark, sf):
    from seqrec.sources.metrics_io import write_metrics
    path = scratch_path(spark, "metrics")
    began = time.monotonic()
    metrics = cut(q_precision_recall(spark, sf), "metrics")
    write_metrics(metrics, path, seconds=time.monotonic() - began)
    back = spark.read.schema("precision double, recall double, users bigint, norec bigint, seconds double").json(path)
    return back.withColumn("timed", F.col("seconds") > 0).drop("seconds")
