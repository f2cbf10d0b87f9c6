"""Thresholds of the operators. Results depend on them."""

MA_WINDOWS = (5, 10, 20, 60, 120, 250)
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
RSI_WINDOWS = (6, 12, 24)
BOLL_WINDOW, BOLL_STD = 20, 2
VOL_MA_WINDOWS = (5, 10)
STATS_WINDOWS = (20, 60)
KDJ_WINDOW, KDJ_K, KDJ_D = 9, 3, 3

CHIP_DECAY = 0.7
CHIP_CAP = 0.8
CHIP_BINS = 2000
CHIP_BURN_IN = 90
CHIP_PAD = 0.1

PLATEAU_TOL = 0.001
MAX_ACTION_LAG = 2

ANCHOR_LOOKBACK = 26
PANIC_BASE_WEEKS = 20
PANIC_VOLUME = 2.0
SHADOW_BODY = 2.0
SHADOW_RANGE = 0.35
YANG_BODY = 0.60
YANG_GAIN = 0.05
DRYUP_WEEKS = 4
DRYUP_RATIO = 0.50
NO_LOW_WEEKS = 3
PIVOT_SIDE = 2
DIVERGENCE_LOOKBACK = 26
DURATION_WEEKS = 8
ACTIVE_WEEKS = 4
MIN_ACTIVE = 2

BREACH_PCT = "0.01"
CONFIRM_DAYS = 2
PROXIMITY_PCT = "0.03"

BREAKOUT_PCT = "0.01"
RIGHT_VOLUME_DAYS = 20
RIGHT_VOLUME = 1.5
RETEST_DAYS = 10
RETEST_BAND = "0.02"
RETEST_HOLD = "0.01"
INVALIDATE_PCT = "0.01"

FASTLANE_PCT = "0.02"

BREAKDOWN_DROP = 0.05
BREAKDOWN_VOLUME = 2.0
BREAKDOWN_LOW_DAYS = 60
CONSOLIDATION_MIN, CONSOLIDATION_MAX = 10, 120
CONSOLIDATION_RANGE = 0.15
CONSOLIDATION_VOLUME = 0.8
MA_SPREAD = 0.05
PROBE_SHADOW = 0.5
PROBE_AMPLITUDE = 0.03
PROBE_VOLUME = 1.5
CONFIRM_VOLUME = 1.5
CONTINUE_DROP = 0.03
CONSOLIDATION_EXPIRY = 120

WEEKLY_SIGNALS = ("panic", "dry_up", "no_new_low_3w", "divergence", "duration")
