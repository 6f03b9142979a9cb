"""Parameters of the registered queries on the driver's tables.

The reference's defaults (10 s blocks, K=30, ...) assume second timestamps
and dense movie logs.  View E has microsecond timestamps and a median gap of
about 7 h per user, so the registered queries scale the time constants.
"""

# Fixed values used by the registered queries on view E.
MICROS_PER_SECOND = 1_000_000
DAY_E = 86_400 * MICROS_PER_SECOND      # one day in E's ts unit
GAP_E = 6 * 3_600 * MICROS_PER_SECOND   # block / session gap on E: 6 hours
TEST_PCT = 20                           # newest 20 % of events are test
K_ITEM = 30                             # item neighbours
K_USER = 200                            # user neighbours
K_IMPLICIT = 50                         # neighbours of the implicit-feedback baseline
N_RECS = 10                             # recommendations per list
DELTA = 40                              # position window of the user similarity
PHASE_DAYS_E = 7                        # age phases on E (all ages < 30 days)
REFRESH_PCT = 5                         # refresh the user network every 5 % of events
N_EMB = 5                               # embedding / factor recommendations
FACTORS = 100                           # latent factors of a user or item
EMB_TOPN = 100                          # most_similar topn
EMB_RECENT = 3                          # recent items as positives
SESSION_GAP_E = 24 * 3_600 * MICROS_PER_SECOND
MIN_SESSION_ITEMS = 3                   # users need more than this many items
GAP_L = 30 * 86_400                     # block gap on view L (ts in seconds, dates only)
