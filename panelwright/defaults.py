"""Default parameters. Results depend on them."""

HORIZON_BARS = 21
TRADING_DAYS = 252
HALFLIFE_BARS = 63.0
ERROR_WARMUP_BARS = 21
MIN_ERROR_SAMPLES = 10
RISK_AVERSION = 2.5
TAU = 0.05
MAX_WEIGHT = 0.60
TURNOVER_COST = 0.002
WEIGHT_CLIP = 1e-8
CONFIDENCE_FLOOR = 0.02
CONFIDENCE_CEIL = 0.95
SIGMA_FLOOR = 1e-8
CALIBRATION_Z = 1.64
COVERAGE_TARGET = 0.90
COVERAGE_TOLERANCE = 0.05
OVERLAP_DAYS = 10
ADJ_REL_TOL = 1e-4
MIN_COV_ROWS = 60
PSD_TOL = 1e-10
FFD_THRESHOLD = 1e-5
MIN_ADF_SAMPLES = 100
ADF_PVALUE = 0.05
JITTER_SCALES = (0.0, 1e-10, 1e-8)
STD_MEDIAN_FLOOR = 0.1
EFFECTIVE_RANK_FLOOR = 1.5
STAGES = ("freshness", "ingest", "features", "forecast", "blend", "optimize")
