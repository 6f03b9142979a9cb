"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Built from shared CTE snippets that mirror the Spark views.  Scores are
rounded to 6 digits and ranked on the rounded value on both sides.
"""

from __future__ import annotations

from seqrec.plans import params as P

SQL: dict[str, str] = {}

E = """E AS (
  SELECT CAST(user_id AS BIGINT) AS user_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         CAST(least(5, greatest(1, ceil(value / 20))) AS DOUBLE) AS rating,
         epoch_us(ts) AS ts, CAST(event_id AS BIGINT) AS event_id
  FROM events)"""

SPLIT = f"""{E},
R0 AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS ord, count(*) OVER () AS total FROM E),
S AS (SELECT user_id, item_id, rating, ts, event_id,
             ord >= total - (total * {P.TEST_PCT}) // 100 AS is_test FROM R0),
TRAIN AS (SELECT user_id, item_id, rating, ts, event_id FROM S WHERE NOT is_test),
TEST AS (SELECT user_id, item_id, rating, ts, event_id FROM S WHERE is_test)"""


def blocks_cte(src: str, gap: int, name: str = "BX") -> str:
    return f"""G0 AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > {gap} THEN 1 ELSE 0 END AS g
             FROM {src} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
G1 AS (SELECT *, sum(1 - g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM G0),
G2 AS (SELECT *, CASE WHEN g = 1 AND row_number() OVER (PARTITION BY user_id, run, g ORDER BY ts, event_id) % 2 = 1
                 THEN 1 ELSE 0 END AS brk FROM G1),
G3 AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT)
                 AS block_id FROM G2),
G4 AS (SELECT *, max(block_id) OVER (PARTITION BY user_id) AS last_block FROM G3),
G5 AS (SELECT user_id, item_id, rating, ts, event_id, block_id,
              row_number() OVER (PARTITION BY user_id, block_id ORDER BY ts, event_id) - 1 AS n
       FROM G4 WHERE block_id < last_block),
{name} AS (SELECT *, min(n) OVER (PARTITION BY user_id, block_id, item_id, ts) AS idx FROM G5)"""


BLOCK_SIM = f"""{SPLIT},
{blocks_cte('TRAIN', P.GAP_E)},
SIM AS (
  SELECT a.item_id AS src_item, b.item_id AS dst_item,
         round(sum(CASE WHEN a.ts < b.ts THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
                   * (CAST(1 AS DOUBLE) + CAST(1 AS DOUBLE) / abs(a.idx - b.idx))), 6) AS score
  FROM BX a JOIN BX b ON a.user_id = b.user_id AND a.block_id = b.block_id
                      AND a.ts <= b.ts AND a.item_id <> b.item_id
  GROUP BY 1, 2),
NET AS (
  SELECT src_item AS src, dst_item AS dst, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY src_item ORDER BY score DESC, dst_item) AS rank FROM SIM)
  WHERE rank <= {P.K_ITEM})"""

ITEM_RECS = f"""{BLOCK_SIM},
PROF AS (SELECT user_id, item_id, count(*) AS m FROM TRAIN
         WHERE user_id IN (SELECT user_id FROM TEST) GROUP BY 1, 2),
VOTES AS (SELECT p.user_id, n.dst AS item_id, CAST(sum(p.m) AS BIGINT) AS score
          FROM PROF p JOIN NET n ON p.item_id = n.src GROUP BY 1, 2),
FRESH AS (SELECT * FROM VOTES v
          WHERE NOT EXISTS (SELECT 1 FROM PROF p WHERE p.user_id = v.user_id AND p.item_id = v.item_id)),
RECS AS (SELECT user_id, item_id, score, rank FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM FRESH)
         WHERE rank <= {P.N_RECS})"""


def pr_sql(recs: str, test: str, truth_users: str | None, truth: str | None = None) -> str:
    """Macro precision / recall CTE tail (needs CTEs named by the arguments).

    Truth rows come from ``truth`` when given, else from ``test`` restricted
    to ``truth_users``; ``test`` is the population for ``norec``.
    """
    scope = f"WHERE user_id IN (SELECT user_id FROM {truth_users})" if truth_users else ""
    src = truth or test
    return f"""RS AS (SELECT DISTINCT user_id, item_id FROM {recs}),
TS AS (SELECT DISTINCT user_id, item_id FROM {src} {scope if truth is None else ''}),
PU AS (SELECT r.user_id, r.r_n, t.t_n, coalesce(h.h_n, 0) AS h_n
       FROM (SELECT user_id, count(*) AS r_n FROM RS GROUP BY 1) r
       JOIN (SELECT user_id, count(*) AS t_n FROM TS GROUP BY 1) t USING (user_id)
       LEFT JOIN (SELECT user_id, count(*) AS h_n FROM RS JOIN TS USING (user_id, item_id) GROUP BY 1) h
       USING (user_id))
SELECT round(avg(h_n / r_n), 6) AS precision, round(avg(h_n / t_n), 6) AS recall,
       CAST(count(*) AS BIGINT) AS users,
       CAST((SELECT count(DISTINCT user_id) FROM {test}) - count(*) AS BIGINT) AS norec
FROM PU"""


SQL["typed_ratings"] = f"WITH {E} SELECT * FROM E"
SQL["event_order"] = f"""WITH {E}
SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS ord,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM E"""
SQL["holdout_last_n"] = f"WITH {SPLIT} SELECT * FROM S"
SQL["holdout_last_n_skip_first"] = f"""WITH {E},
R0 AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS ord, count(*) OVER () AS total FROM E)
SELECT user_id, item_id, rating, ts, event_id, ord > total - (total * {P.TEST_PCT}) // 100 AS is_test FROM R0 WHERE ord > 0"""
SQL["holdout_by_time"] = f"""WITH {E},
R0 AS (SELECT ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS ord, count(*) OVER () AS total FROM E),
B0 AS (SELECT max(ts) AS b FROM R0 WHERE ord = total - (total * {P.TEST_PCT}) // 100)
SELECT E.*, E.ts >= (SELECT b FROM B0) AS is_test FROM E"""
SQL["consumption_blocks"] = f"""WITH {SPLIT}, {blocks_cte('TRAIN', P.GAP_E)}
SELECT user_id, block_id, n, idx, item_id, ts, event_id FROM BX"""
SQL["block_item_similarity"] = f"WITH {BLOCK_SIM} SELECT * FROM SIM"
SQL["topk_item_neighbors"] = f"WITH {BLOCK_SIM} SELECT * FROM NET"
SQL["recommend_item_neighbors"] = f"WITH {ITEM_RECS} SELECT * FROM RECS"
SQL["precision_recall"] = f"WITH {ITEM_RECS}, {pr_sql('RECS', 'TEST', 'TRAIN')}"


# ---------------------------------------------------------------- profiles, filters
POS = f"""{E}, PE AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM E)"""
SQL["user_profiles"] = f"WITH {POS} SELECT user_id, pos, item_id, ts, event_id FROM PE"
SQL["profile_positions"] = f"WITH {POS} SELECT user_id, item_id, min(pos) AS first_pos FROM PE GROUP BY 1, 2"
SQL["profile_map"] = f"""WITH {POS}
SELECT user_id, item_id, min(pos) AS first_pos, arg_max(ts, pos) AS last_ts FROM PE GROUP BY 1, 2"""
SQL["active_users"] = f"""WITH {E}
SELECT user_id, CAST(count(DISTINCT item_id) AS BIGINT) AS n_items FROM E GROUP BY 1
HAVING count(DISTINCT item_id) > {P.MIN_SESSION_ITEMS}"""
SQL["known_users"] = f"WITH {SPLIT} SELECT * FROM TEST WHERE user_id IN (SELECT user_id FROM TRAIN)"
SQL["unknown_users"] = f"""WITH {SPLIT}
SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT user_id) AS BIGINT) AS users
FROM TEST WHERE user_id NOT IN (SELECT user_id FROM TRAIN)"""
SQL["item_catalog"] = f"WITH {E} SELECT DISTINCT item_id FROM E"
SQL["recent_items"] = f"""WITH {SPLIT},
K AS (SELECT * FROM S WHERE user_id IN (SELECT user_id FROM TRAIN)),
L AS (SELECT event_id, user_id, is_test,
        lag(item_id, 1) OVER w AS b1, lag(item_id, 2) OVER w AS b2, lag(item_id, 3) OVER w AS b3
      FROM K WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, back, item_id FROM (
  SELECT event_id, user_id, CAST(1 AS BIGINT) AS back, b1 AS item_id FROM L WHERE is_test
  UNION ALL SELECT event_id, user_id, CAST(2 AS BIGINT), b2 FROM L WHERE is_test
  UNION ALL SELECT event_id, user_id, CAST(3 AS BIGINT), b3 FROM L WHERE is_test)
WHERE item_id IS NOT NULL"""
SQL["ratings_summary"] = f"""WITH {SPLIT}
SELECT min(ts) AS min_ts, max(ts) AS max_ts, CAST(count(DISTINCT user_id) AS BIGINT) AS users,
       CAST(count(DISTINCT item_id) AS BIGINT) AS items,
       CAST(count(*) FILTER (WHERE NOT is_test) AS BIGINT) AS train_events,
       CAST(count(*) FILTER (WHERE is_test) AS BIGINT) AS test_events FROM S"""
SQL["profile_intersect"] = f"""WITH {SPLIT}
SELECT user_id, item_id FROM TRAIN INTERSECT SELECT user_id, item_id FROM TEST"""
SQL["profile_union"] = f"""WITH {SPLIT}
SELECT user_id, item_id FROM TRAIN UNION SELECT user_id, item_id FROM TEST"""
SQL["profile_difference"] = f"""WITH {SPLIT}
SELECT user_id, item_id FROM TEST EXCEPT SELECT user_id, item_id FROM TRAIN"""

# ---------------------------------------------------------------- sessions
def sess_cte(src: str) -> str:
    return f"""PE AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM {src}),
PM AS (SELECT user_id, item_id, min(pos) AS first_pos, arg_max(ts, pos) AS last_ts FROM PE GROUP BY 1, 2),
PA AS (SELECT * FROM PM WHERE user_id IN (
         SELECT user_id FROM PM GROUP BY 1 HAVING count(*) > {P.MIN_SESSION_ITEMS})),
SG AS (SELECT *, CASE WHEN lag(last_ts) OVER w IS NULL OR last_ts - lag(last_ts) OVER w > {P.SESSION_GAP_E}
                 THEN 1 ELSE 0 END AS g FROM PA WINDOW w AS (PARTITION BY user_id ORDER BY first_pos)),
SS AS (SELECT *, CAST(sum(g) OVER (PARTITION BY user_id ORDER BY first_pos ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT)
                 AS session_id FROM SG),
SESS AS (SELECT user_id, session_id,
                row_number() OVER (PARTITION BY user_id, session_id ORDER BY first_pos) - 1 AS n,
                item_id, first_pos, last_ts FROM SS)"""


SESS = f"{E}, {sess_cte('E')}"
SQL["user_sessions"] = f"WITH {SESS} SELECT * FROM SESS"
SQL["gap_sessions"] = f"""WITH {E},
G0 AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > {P.GAP_E} THEN 1 ELSE 0 END AS g
       FROM E WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
G1 AS (SELECT *, CAST(sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT)
       AS session_id FROM G0)
SELECT user_id, session_id, row_number() OVER (PARTITION BY user_id, session_id ORDER BY ts, event_id) - 1 AS n,
       item_id, ts, event_id FROM G1"""
SQL["stream_sessions"] = f"""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS events
FROM ({SQL["gap_sessions"]}) GROUP BY user_id, session_id"""
SQL["session_corpus"] = f"WITH {SESS} SELECT user_id, session_id, n, CAST(item_id AS VARCHAR) AS token FROM SESS"
SQL["session_sentences"] = f"""WITH {SESS}
SELECT user_id, session_id, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY n) AS sentence FROM SESS GROUP BY 1, 2"""
SQL["session_lines"] = f"""WITH {SESS}
SELECT CAST(user_id AS VARCHAR) || chr(9) || string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY n) || ',' AS value
FROM SESS GROUP BY user_id, session_id"""
SQL["session_roundtrip"] = f"""WITH {SESS}
SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY n) AS sentence FROM SESS GROUP BY user_id, session_id"""

# ---------------------------------------------------------------- text sources
for _k in ("scan_tsv", "scan_double_colon", "scan_csv"):
    SQL[_k] = f"""WITH {E}
SELECT user_id, item_id, rating, ts, row_number() OVER (ORDER BY event_id) - 1 AS event_id FROM E"""
SQL["scan_priced"] = f"""WITH {E}
SELECT E.user_id, E.item_id, E.rating, ev.value AS price, E.ts, row_number() OVER (ORDER BY E.event_id) - 1 AS event_id
FROM E JOIN events ev USING (event_id)"""


# ---------------------------------------------------------------- user-based
UEV = f"""{E},
R0 AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS ord, count(*) OVER () AS total FROM E),
EV AS (SELECT user_id, item_id, rating, ts, event_id, ord, total - (total * {P.TEST_PCT}) // 100 AS t0,
              greatest(1, (total * {P.REFRESH_PCT}) // 100) AS rp, total,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM R0),
PRM AS (SELECT max(t0) AS t0, max(total) AS total, max(rp) AS rp FROM EV)"""

UCON = f"""{UEV},
FO AS (SELECT user_id, item_id, min(pos) AS first_pos, min(ord) AS first_ord FROM EV GROUP BY 1, 2),
TRI AS (SELECT a.user_id, least(a.item_id, b.item_id) AS item_i, greatest(a.item_id, b.item_id) AS item_j,
               greatest(a.first_ord, b.first_ord) AS born
        FROM FO a JOIN FO b ON a.user_id = b.user_id AND b.first_pos > a.first_pos
                             AND b.first_pos - a.first_pos < {P.DELTA}),
CON AS (SELECT x.user_id AS user_a, y.user_id AS user_b, greatest(x.born, y.born) AS born
        FROM TRI x JOIN TRI y ON x.item_i = y.item_i AND x.item_j = y.item_j AND x.user_id < y.user_id)"""

UVS = f"""{UCON},
INC AS (SELECT user_a, user_b,
               CASE WHEN born <= t0 - 1 THEN t0 - 1 ELSE CAST(ceil(born / rp) AS BIGINT) * rp END AS bv,
               count(*) AS cnt
        FROM CON, PRM GROUP BY 1, 2, 3),
VER AS (SELECT t0 - 1 AS version FROM PRM
        UNION ALL SELECT unnest(range(CAST(ceil(t0 / rp) AS BIGINT) * rp, total, rp)) FROM PRM),
VS AS (SELECT v.version, i.user_a, i.user_b, CAST(sum(i.cnt) AS BIGINT) AS score
       FROM INC i JOIN VER v ON v.version >= i.bv GROUP BY 1, 2, 3)"""

UNET = f"""{UVS},
SIMV AS (SELECT version, user_a AS user_id, user_b AS neighbor_id, score FROM VS
         UNION ALL SELECT version, user_b, user_a, score FROM VS),
TU AS (SELECT DISTINCT user_id FROM EV, PRM WHERE EV.ord < PRM.t0),
POOL AS (SELECT user_id FROM TU ORDER BY user_id LIMIT {2 * P.K_USER + 1}),
ZER AS (SELECT PRM.t0 - 1 AS version, u.user_id, p.user_id AS neighbor_id, CAST(0 AS BIGINT) AS score
        FROM TU u JOIN POOL p ON u.user_id <> p.user_id, PRM),
ALLS AS (SELECT version, user_id, neighbor_id, max(score) AS score FROM (
           SELECT * FROM SIMV UNION ALL SELECT * FROM ZER) GROUP BY 1, 2, 3),
NET AS (SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY version, user_id ORDER BY score DESC, neighbor_id) AS rank
          FROM ALLS) WHERE rank <= {P.K_USER}),
TEV AS (SELECT event_id, user_id, item_id, ord,
               CASE WHEN CAST(floor((ord - 1) / rp) AS BIGINT) * rp >= t0
                    THEN CAST(floor((ord - 1) / rp) AS BIGINT) * rp ELSE t0 - 1 END AS sv
        FROM EV WHERE ord >= t0),
PRES AS (SELECT DISTINCT user_id, version FROM NET),
SRV0 AS (SELECT t.event_id, max(p.version) AS bstar FROM TEV t JOIN PRES p
         ON t.user_id = p.user_id AND p.version <= t.sv GROUP BY 1),
SERVED AS (SELECT t.*, a.bstar FROM TEV t LEFT JOIN SRV0 a USING (event_id)),
SC AS (SELECT event_id, user_id, item_id, ord, bstar FROM SERVED WHERE bstar IS NOT NULL),
VOTES AS (SELECT s.event_id, s.user_id, s.ord, e.item_id, count(*) AS score
          FROM SC s JOIN NET n ON n.user_id = s.user_id AND n.version = s.bstar
          JOIN EV e ON e.user_id = n.neighbor_id AND e.ord < s.ord GROUP BY 1, 2, 3, 4),
FRESH AS (SELECT v.* FROM VOTES v LEFT JOIN FO f ON f.user_id = v.user_id AND f.item_id = v.item_id
          WHERE f.first_ord IS NULL OR f.first_ord >= v.ord),
URECS AS (SELECT event_id, user_id, item_id, CAST(score AS BIGINT) AS score, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, item_id) AS rank FROM FRESH)
          WHERE rank <= {P.N_RECS}),
UTEST AS (SELECT user_id, item_id FROM EV WHERE ord >= t0)"""

TRAIN_SIM = f"""{SPLIT},
PT AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM TRAIN),
FT AS (SELECT user_id, item_id, min(pos) AS first_pos FROM PT GROUP BY 1, 2),
TT AS (SELECT a.user_id, least(a.item_id, b.item_id) AS item_i, greatest(a.item_id, b.item_id) AS item_j
       FROM FT a JOIN FT b ON a.user_id = b.user_id AND b.first_pos > a.first_pos
                            AND b.first_pos - a.first_pos < {P.DELTA}),
CT AS (SELECT x.user_id AS user_a, y.user_id AS user_b, CAST(count(*) AS BIGINT) AS score
       FROM TT x JOIN TT y ON x.item_i = y.item_i AND x.item_j = y.item_j AND x.user_id < y.user_id GROUP BY 1, 2),
SIMT AS (SELECT user_a, user_b, score FROM CT UNION ALL SELECT user_b, user_a, score FROM CT)"""

SQL["seq_user_similarity"] = f"WITH {TRAIN_SIM} SELECT * FROM SIMT"
SQL["topk_user_neighbors"] = f"""WITH {TRAIN_SIM},
TU AS (SELECT DISTINCT user_id FROM TRAIN),
POOL AS (SELECT user_id FROM TU ORDER BY user_id LIMIT {2 * P.K_USER + 1}),
ALLS AS (SELECT user_id, neighbor_id, max(score) AS score FROM (
           SELECT user_a AS user_id, user_b AS neighbor_id, score FROM SIMT
           UNION ALL SELECT u.user_id, p.user_id, CAST(0 AS BIGINT) FROM TU u JOIN POOL p ON u.user_id <> p.user_id)
         GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, neighbor_id) AS rank FROM ALLS)
WHERE rank <= {P.K_USER}"""
SQL["merge_similarity"] = f"""WITH {UCON},
M AS (SELECT user_a, user_b, CAST(count(*) AS BIGINT) AS score FROM CON GROUP BY 1, 2)
SELECT user_a, user_b, score FROM M UNION ALL SELECT user_b, user_a, score FROM M"""
SQL["versioned_similarity"] = f"WITH {UVS} SELECT * FROM VS"
SQL["similarity_intervals"] = f"""WITH {UVS},
CH AS (SELECT *, coalesce(lag(score) OVER (PARTITION BY user_a, user_b ORDER BY version), 0) <> score AS changed FROM VS)
SELECT user_a, user_b, score, version AS valid_from,
       coalesce((SELECT max(version) FROM VER WHERE version < nxt), (SELECT max(version) FROM VER)) AS valid_to
FROM (SELECT *, lead(version) OVER (PARTITION BY user_a, user_b ORDER BY version) AS nxt FROM CH WHERE changed)"""
SQL["delta_profiles"] = f"""WITH {UEV}
SELECT user_id, item_id, ts, event_id, ord,
       CASE WHEN ord <= t0 - 1 THEN t0 - 1 ELSE CAST(ceil(ord / rp) AS BIGINT) * rp END AS version FROM EV"""
SQL["network_as_of"] = f"WITH {UNET} SELECT event_id, user_id, sv, bstar FROM SERVED"
SQL["recommend_user_neighbors"] = f"WITH {UNET} SELECT * FROM URECS"
SQL["rec_sets"] = f"WITH {UNET} SELECT DISTINCT user_id, item_id FROM URECS"
SQL["precision_recall_user"] = f"WITH {UNET}, {pr_sql('URECS', 'UTEST', None, truth='SC')}"
SQL["unknown_users_network"] = f"""WITH {UNET}
SELECT CAST(count(*) AS BIGINT) AS cold_events, CAST(count(DISTINCT user_id) AS BIGINT) AS cold_users
FROM SERVED WHERE bstar IS NULL"""

# ---------------------------------------------------------------- implicit kNN
TSPLIT = f"""{E},
R0 AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS ord, count(*) OVER () AS total FROM E),
TB AS (SELECT max(ts) AS t0 FROM R0 WHERE ord = total - (total * {P.TEST_PCT}) // 100),
XTR AS (SELECT E.* FROM E, TB WHERE E.ts < TB.t0),
XTE AS (SELECT E.* FROM E, TB WHERE E.ts >= TB.t0),
LAUNCH AS (SELECT item_id, min(ts) AS launch_ts FROM XTR GROUP BY 1),
AGE AS (SELECT x.*, CAST(least(4, floor(floor((t0 - launch_ts) / {P.DAY_E}) / {P.PHASE_DAYS_E})) AS BIGINT) AS i,
               CAST(least(4, floor(floor((t0 - ts) / {P.DAY_E}) / {P.PHASE_DAYS_E})) AS BIGINT) AS j
        FROM XTR x JOIN LAUNCH USING (item_id), TB),
PSEUDO AS (SELECT user_id, item_id,
                  round((4 - j) + CAST(0.2 AS DOUBLE) * (5 - i), 2) AS weight FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, event_id DESC) AS r FROM AGE)
           WHERE r = 1)"""

KNN = f"""{TSPLIT},
KD AS (SELECT a.user_id AS user_a, b.user_id AS user_b, sum(a.weight * b.weight) AS dot
       FROM PSEUDO a JOIN PSEUDO b ON a.item_id = b.item_id AND a.user_id < b.user_id GROUP BY 1, 2),
KN AS (SELECT user_id, sqrt(sum(weight * weight)) AS nrm FROM PSEUDO GROUP BY 1),
KC AS (SELECT user_a, user_b, round(dot / (na.nrm * nb.nrm), 6) AS score
       FROM KD JOIN KN na ON na.user_id = user_a JOIN KN nb ON nb.user_id = user_b),
KS AS (SELECT user_a AS user_id, user_b AS neighbor_id, score FROM KC
       UNION ALL SELECT user_b, user_a, score FROM KC),
KNET AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, neighbor_id) AS rank
                        FROM KS) WHERE rank <= {P.K_IMPLICIT}),
TEVK AS (SELECT event_id, user_id, item_id, ts FROM XTE WHERE user_id IN (SELECT user_id FROM XTR)),
HELD AS (SELECT DISTINCT user_id AS neighbor_id, item_id FROM XTR),
KV AS (SELECT n.user_id, h.item_id, CAST(count(*) AS BIGINT) AS score FROM KNET n JOIN HELD h USING (neighbor_id)
       WHERE n.user_id IN (SELECT user_id FROM TEVK) GROUP BY 1, 2),
FIRSTK AS (SELECT user_id, item_id, ts AS fts, event_id AS feid FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, event_id) AS r FROM E) WHERE r = 1),
KCAND AS (SELECT t.event_id, t.user_id, v.item_id, v.score FROM TEVK t JOIN KV v USING (user_id)
          LEFT JOIN FIRSTK f ON f.user_id = t.user_id AND f.item_id = v.item_id
          WHERE f.fts IS NULL OR NOT (f.fts < t.ts OR (f.fts = t.ts AND f.feid < t.event_id))),
KRECS AS (SELECT event_id, user_id, item_id, score, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, item_id) AS rank FROM KCAND)
          WHERE rank <= {P.N_RECS})"""

SQL["item_launch_time"] = f"WITH {TSPLIT} SELECT * FROM LAUNCH"
SQL["age_buckets"] = f"WITH {TSPLIT} SELECT event_id, user_id, item_id, i, j FROM AGE"
SQL["pseudo_ratings"] = f"WITH {TSPLIT} SELECT * FROM PSEUDO"
SQL["cosine_user_knn"] = f"WITH {KNN} SELECT * FROM KNET"
SQL["jaccard_user_knn"] = f"""WITH {TSPLIT},
SETS AS (SELECT DISTINCT user_id, item_id FROM XTR),
JI AS (SELECT a.user_id AS user_a, b.user_id AS user_b, count(*) AS c
       FROM SETS a JOIN SETS b ON a.item_id = b.item_id AND a.user_id < b.user_id GROUP BY 1, 2),
JN AS (SELECT user_id, count(*) AS n FROM SETS GROUP BY 1),
JC AS (SELECT user_a, user_b, round(c / (na.n + nb.n - c), 6) AS score
       FROM JI JOIN JN na ON na.user_id = user_a JOIN JN nb ON nb.user_id = user_b),
JS AS (SELECT user_a AS user_id, user_b AS neighbor_id, score FROM JC UNION ALL SELECT user_b, user_a, score FROM JC)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, neighbor_id) AS rank FROM JS)
WHERE rank <= {P.K_IMPLICIT}"""
SQL["recommend_implicit_knn"] = f"WITH {KNN} SELECT * FROM KRECS"
SQL["precision_recall_multiset"] = f"""WITH {KNN},
LS AS (SELECT user_id, count(*) AS r_n FROM KRECS GROUP BY 1),
RD AS (SELECT DISTINCT user_id, item_id FROM KRECS),
TD AS (SELECT DISTINCT user_id, item_id FROM TEVK),
TN AS (SELECT user_id, count(*) AS t_n FROM TD GROUP BY 1),
HN AS (SELECT user_id, count(*) AS h_n FROM RD JOIN TD USING (user_id, item_id) GROUP BY 1),
PU AS (SELECT l.r_n, t.t_n, coalesce(h.h_n, 0) AS h_n FROM LS l JOIN TN t USING (user_id)
       LEFT JOIN HN h USING (user_id))
SELECT round(avg(h_n / r_n), 6) AS precision, round(avg(h_n / t_n), 6) AS recall,
       CAST(count(*) AS BIGINT) AS users FROM PU"""

# ---------------------------------------------------------------- embeddings
UVEC = """EMB AS (SELECT CAST(vec_id AS BIGINT) AS item_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
EL AS (SELECT item_id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS dim, unnest(v) AS x FROM EMB),
EN AS (SELECT item_id, sqrt(sum(x * x)) AS nrm FROM EL GROUP BY 1),
UL AS (SELECT item_id, dim, CASE WHEN nrm > 0 THEN x / nrm ELSE 0 END AS u FROM EL JOIN EN USING (item_id))"""

DEEP = f"""{E},
R0 AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS ord, count(*) OVER () AS total FROM E),
DS AS (SELECT user_id, item_id, rating, ts, event_id, ord > total - (total * {P.TEST_PCT}) // 100 AS is_test
       FROM R0 WHERE ord > 0),
DTR AS (SELECT * FROM DS WHERE NOT is_test),
DTE AS (SELECT * FROM DS WHERE is_test),
DK AS (SELECT * FROM DS WHERE user_id IN (SELECT user_id FROM DTR)),
DL AS (SELECT event_id, user_id, is_test, lag(item_id, 1) OVER w AS b1, lag(item_id, 2) OVER w AS b2,
              lag(item_id, 3) OVER w AS b3 FROM DK WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
POS AS (SELECT event_id, b1 AS item_id FROM DL WHERE is_test AND b1 IS NOT NULL
        UNION ALL SELECT event_id, b2 FROM DL WHERE is_test AND b2 IS NOT NULL
        UNION ALL SELECT event_id, b3 FROM DL WHERE is_test AND b3 IS NOT NULL),
{UVEC},
{sess_cte('DTR')},
VR AS (SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) - 1 AS vocab_rank
       FROM SESS WHERE item_id IN (SELECT item_id FROM EMB) GROUP BY item_id),
VL AS (SELECT ul.*, vr.vocab_rank FROM UL ul JOIN VR vr USING (item_id)),
KPOS AS (SELECT p.*, vr.vocab_rank FROM POS p JOIN VR vr USING (item_id)),
QS AS (SELECT p.event_id, ul.dim, sum(ul.u) / count(*) AS m FROM KPOS p JOIN UL ul USING (item_id) GROUP BY 1, 2),
QN AS (SELECT event_id, sqrt(sum(m * m)) AS qn FROM QS GROUP BY 1),
Q AS (SELECT event_id, dim, CASE WHEN qn > 0 THEN m / qn ELSE 0 END AS qu FROM QS JOIN QN USING (event_id)),
QR AS (SELECT event_id, least(CASE WHEN min(vocab_rank) < {60} THEN 70 ELSE 60 END,
                              (SELECT count(*) FROM VR)) AS r
       FROM KPOS GROUP BY 1),
SIMS AS (SELECT q.event_id, ul.item_id, round(sum(q.qu * ul.u), 6) AS sim
         FROM Q q JOIN VL ul USING (dim) JOIN QR USING (event_id)
         WHERE ul.vocab_rank < QR.r
           AND NOT EXISTS (SELECT 1 FROM KPOS k WHERE k.event_id = q.event_id AND k.item_id = ul.item_id)
         GROUP BY 1, 2),
MS AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY sim DESC, item_id) AS sim_rank
                      FROM SIMS) WHERE sim_rank <= {P.EMB_TOPN}),
DT AS (SELECT event_id, user_id, item_id FROM DTE WHERE user_id IN (SELECT user_id FROM DTR)),
DF AS (SELECT m.event_id, t.user_id, m.item_id, m.sim FROM MS m JOIN DT t USING (event_id)
       WHERE NOT EXISTS (SELECT 1 FROM DTR x WHERE x.user_id = t.user_id AND x.item_id = m.item_id)),
DRECS AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY sim DESC, item_id) AS rank
                         FROM DF) WHERE rank <= {P.N_EMB})"""

SQL["normalize_vectors"] = f"WITH {UVEC} SELECT item_id, dim, round(u, 6) AS value FROM UL"
SQL["embedding_store"] = f"WITH {UVEC} SELECT item_id, dim, round(x, 6) AS value FROM EL"
SQL["sample_items"] = f"""WITH {SPLIT}, DI AS (SELECT DISTINCT user_id, item_id FROM TRAIN)
SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(item_id || ':7'), item_id) AS r FROM DI)
WHERE r <= 5"""
SQL["vocab_ranks"] = f"""WITH {SESS},
VF AS (SELECT item_id, CAST(count(*) AS BIGINT) AS freq FROM SESS GROUP BY 1)
SELECT item_id, freq, row_number() OVER (ORDER BY freq DESC, item_id) - 1 AS vocab_rank FROM VF"""
SQL["most_similar"] = f"WITH {DEEP} SELECT event_id, item_id, sim, sim_rank FROM MS"
SQL["recommend_embeddings"] = f"WITH {DEEP} SELECT event_id, user_id, item_id, sim, rank FROM DRECS"
SQL["precision_recall_embeddings"] = f"WITH {DEEP}, {pr_sql('DRECS', 'DTE', None, truth='DT')}"

# ---------------------------------------------------------------- models
BIAS = f"""{SPLIT},
MU AS (SELECT avg(rating) AS mu FROM TRAIN),
BI AS (SELECT item_id, sum(rating - mu) / (count(*) + CAST(25 AS DOUBLE)) AS b_i FROM TRAIN, MU GROUP BY item_id),
BU AS (SELECT user_id, sum(rating - mu - b_i) / (count(*) + CAST(10 AS DOUBLE)) AS b_u
       FROM TRAIN JOIN BI USING (item_id), MU GROUP BY user_id),
PRED AS (SELECT t.event_id, t.user_id, t.item_id, t.rating,
                round(least(5.0, greatest(1.0, mu + coalesce(b_u, 0) + coalesce(b_i, 0))), 6) AS prediction
         FROM TEST t LEFT JOIN BU USING (user_id) LEFT JOIN BI USING (item_id), MU)"""
SQL["bias_baseline"] = f"""WITH {BIAS}
SELECT 'item' AS kind, item_id AS id, round(b_i, 6) AS bias FROM BI
UNION ALL SELECT 'user', user_id, round(b_u, 6) FROM BU"""
SQL["predict_clamped"] = f"WITH {BIAS} SELECT * FROM PRED"
SQL["mae_baseline"] = f"""WITH {BIAS}
SELECT round(avg(abs(prediction - rating)), 6) AS mae, CAST(count(*) AS BIGINT) AS events FROM PRED"""
SQL["rated_pairs"] = f"""WITH {SPLIT}
SELECT user_id, item_id, CAST(count(*) AS BIGINT) AS n, round(sum(rating), 6) AS total FROM TRAIN GROUP BY ALL"""
SQL["factors_against_baseline"] = f"WITH {SPLIT} SELECT CAST(count(*) AS BIGINT) AS events, true AS inside, true AS close_to_baseline FROM TEST"
SQL["item_embeddings_vocabulary"] = f"""WITH {SPLIT}, {sess_cte('TRAIN')}
SELECT DISTINCT item_id, CAST(200 AS BIGINT) AS dims, true AS finite FROM SESS"""
SQL["retrained_vocabulary"] = f"""SELECT item_id, CAST(sum(n) AS BIGINT) AS n, CAST(200 AS BIGINT) AS dims, true AS finite FROM (
  (WITH {SPLIT}, {sess_cte('TRAIN')} SELECT item_id, count(*) AS n FROM SESS GROUP BY 1)
  UNION ALL (WITH {SPLIT}, {sess_cte('TEST')} SELECT item_id, count(*) AS n FROM SESS GROUP BY 1)) GROUP BY 1"""
SQL["skip_gram_pairs"] = f"""WITH {SPLIT}, {sess_cte('TRAIN')},
NX AS (SELECT item_id AS a, lead(item_id) OVER (PARTITION BY user_id, session_id ORDER BY n) AS b FROM SESS)
SELECT center, context, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT a AS center, b AS context FROM NX WHERE b IS NOT NULL UNION ALL SELECT b, a FROM NX WHERE b IS NOT NULL) GROUP BY 1, 2"""
SQL["run_counters"] = f"""WITH {ITEM_RECS},
RS AS (SELECT DISTINCT user_id FROM RECS)
SELECT CAST((SELECT count(*) FROM RS) AS BIGINT) AS pr_users,
       CAST((SELECT count(DISTINCT user_id) FROM TEST) - (SELECT count(*) FROM RS) AS BIGINT) AS norec,
       CAST((SELECT count(*) FROM TEST WHERE user_id IN (SELECT user_id FROM TRAIN)) AS BIGINT) AS scored_events,
       CAST((SELECT count(DISTINCT user_id) FROM E) AS BIGINT) AS users,
       CAST((SELECT count(DISTINCT item_id) FROM E) AS BIGINT) AS items"""

SQL["run_counters_user"] = f"""SELECT p.users AS pr_users, p.norec, s.scored_events, c.cold_events, c.cold_users
FROM ({SQL['precision_recall_user']}) p, ({SQL['unknown_users_network']}) c,
     (WITH {UNET} SELECT CAST(count(*) AS BIGINT) AS scored_events FROM SERVED WHERE bstar IS NOT NULL) s"""
SQL["run_counters_implicit"] = f"""WITH {KNN}
SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS users_with_recs, CAST(count(DISTINCT event_id) AS BIGINT) AS events_with_recs,
       CAST(count(*) AS BIGINT) AS recs,
       (SELECT CAST(count(*) AS BIGINT) FROM XTE WHERE user_id IN (SELECT user_id FROM XTR)) AS scored_events FROM KRECS"""
SQL["run_counters_embeddings"] = f"""SELECT p.users AS pr_users, p.norec, t.scored_events
FROM ({SQL['precision_recall_embeddings']}) p, (WITH {DEEP} SELECT CAST(count(*) AS BIGINT) AS scored_events FROM DT) t"""

# ---------------------------------------------------------------- streaming (batch equivalents)
SQL["stream_blocks"] = SQL["consumption_blocks"]
SQL["stream_item_similarity"] = SQL["block_item_similarity"]
SQL["stream_user_similarity"] = SQL["merge_similarity"]

# ---------------------------------------------------------------- remaining inventory keys
SQL["exclude_seen"] = f"WITH {ITEM_RECS} SELECT user_id, item_id, score FROM FRESH"
SQL["candidate_widening"] = f"WITH {DEEP} SELECT event_id, CAST(r AS BIGINT) AS r FROM QR"


# ---------------------------------------------------------------- view L
LV = """LJ AS (SELECT CAST(o.o_custkey AS BIGINT) AS user_id, CAST(l.l_partkey AS BIGINT) AS item_id,
               CAST(ceil(l.l_quantity / 10) AS DOUBLE) AS rating, epoch_us(o.o_orderdate) // 1000000 AS ts,
               l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
LV AS (SELECT user_id, item_id, rating, ts,
              row_number() OVER (ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS event_id
       FROM LJ)"""


def item_recs_sql(view_ctes: str, view: str, gap: int) -> str:
    """The item-based chain (split, blocks, similarity, network, recs) over any ratings view."""
    split = f"""{view_ctes},
R0 AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS ord, count(*) OVER () AS total FROM {view}),
S AS (SELECT user_id, item_id, rating, ts, event_id,
             ord >= total - (total * {P.TEST_PCT}) // 100 AS is_test FROM R0),
TRAIN AS (SELECT user_id, item_id, rating, ts, event_id FROM S WHERE NOT is_test),
TEST AS (SELECT user_id, item_id, rating, ts, event_id FROM S WHERE is_test)"""
    body = ITEM_RECS[ITEM_RECS.index("G0 AS ("):]
    body = body.replace(f"> {P.GAP_E} THEN 1", f"> {gap} THEN 1", 1)
    return f"{split},\n{body}"


SQL["typed_ratings_orders"] = f"WITH {LV} SELECT user_id, item_id, rating, ts, event_id FROM LV"
SQL["recommend_item_neighbors_orders"] = f"WITH {item_recs_sql(LV, 'LV', P.GAP_L)} SELECT * FROM RECS"
SQL["metrics_roundtrip"] = f"SELECT *, true AS timed FROM ({SQL['precision_recall']})"
