"""Fixed values that results depend on."""

# Number of support pairs an embedding row must carry.
SUPPORT_PAIRS = 4

# Width of one user-embedding row.
EMBEDDING_WIDTH = 3584

# The contract a training latent must meet.
LATENT_SHAPE = (16, 24, 24)
LATENT_SEMANTICS = "stability_train_c_raw_effnet"
LATENT_SCALED = False

# Dataset splits in scan order.
SPLITS = ("train", "validation", "test")

# Texts read as true and as false.
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")
EMPTY_WORDS = ("none", "null", "")

# Texts read as missing by the wide test.
MISSING_WORDS = ("", "none", "null", "nan")

# Text in front of the judge's choice.
ANSWER_MARKER = "Prediction of user preference: "
CALL_FAILED_TEXT = "Inference failed"

# Judge scores.
SCORE_CORRECT = 1
SCORE_WRONG = 0
SCORE_INCONSISTENT = -1
SCORE_UNPARSED = -2
SCORE_FAILED = -3

# Ranks at which classifier accuracy is reported.
TOP_K = (1, 2, 4, 8, 16, 32)

# Quantiles of a latent distribution.
QUANTILES = {
    "p0": 0.0,
    "p1": 0.01,
    "p5": 0.05,
    "p25": 0.25,
    "p50": 0.5,
    "p75": 0.75,
    "p95": 0.95,
    "p99": 0.99,
    "p100": 1.0,
}

# Generation conditions and the pairs compared per sample.
CONDITIONS = ("base", "branch_off", "zero_user", "zero_user_zero_mask", "real_user")
CONDITION_PAIRS = (
    ("base", "branch_off"),
    ("base", "zero_user"),
    ("base", "zero_user_zero_mask"),
    ("base", "real_user"),
    ("zero_user", "zero_user_zero_mask"),
    ("zero_user", "real_user"),
    ("zero_user_zero_mask", "real_user"),
)

# Metrics averaged over one accumulation window.
STEP_METRICS = (
    "loss",
    "total_loss",
    "user_residual_l2_penalty",
    "user_residual_norm",
    "user_base_norm",
    "user_residual_ratio",
    "user_residual_ratio_max",
    "train_pref_err_mean",
    "train_dispref_err_mean",
    "ref_pref_err_mean",
    "ref_dispref_err_mean",
    "score_mean",
    "timestep_min",
    "timestep_max",
    "timestep_mean",
    "step_time_sec",
)

# File name endings of images.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp")

# Fields kept in compact image metadata.
COMPACT_META_FIELDS = (
    "num_occurrences",
    "best_count",
    "non_best_count",
    "caption_samples",
    "partner_uid_samples",
    "source_paths",
)

# Columns of the two CSV reports.
SAMPLE_CSV_COLUMNS = (
    "group", "uid", "category", "prompt", "seed", "shape", "finite_fraction", "nan_count",
    "posinf_count", "neginf_count", "mean", "std", "min", "max", "abs_mean", "rms", "l2_norm",
    "p1", "p5", "p50", "p95", "p99",
)
HISTOGRAM_CSV_COLUMNS = ("bin_left", "bin_right", "prior_count", "precomputed_count")
