"""Defaults shared by all plans; every plan takes them as keyword arguments."""

# featurizing
HASH_WIDTH = 256
MIN_ENTITIES_PER_TOKEN = 3

# Embedding and novelty
PCA_COMPONENTS = 50
NEIGHBORS = 5
TOP_FRACTION = 0.1

# Time-split holdout
CUTOFF_DATE = "2022-09-16"
MAJOR_CLASSES = ("PKS", "NRPS", "hybrid")
CONTROL_REPEATS = 50
SEED = 42
OPEN_END_DATE = "9999"

# Member preparation and pooling
POOLING = "length_weighted"
MAX_MEMBER_LENGTH = 1024
MIN_MEMBER_LENGTH = 10
MAX_MEMBERS = 80

# Class recovery
FOLDS = 5
FOREST_TREES = 300
LOGISTIC_ITERATIONS = 2000

# Columns up to which a covariance matrix is worked out on the driver (64 MB).
DENSE_COLUMNS = 2896
