"""Fixed values of the scoring model; results must equal those made with these numbers."""

# Normalisation.
MAX_AMOUNT = 10000.0
MAX_INSTALLMENTS = 12.0
AMOUNT_VS_AVG_RATIO = 10.0
MAX_MINUTES = 1440.0
MAX_KM = 1000.0
MAX_TX_COUNT_24H = 20.0
MAX_MERCHANT_AVG_AMOUNT = 10000.0

# Risk by merchant category; any other category, and none, has the default.
MCC_RISK = {
    "5411": 0.15,
    "5812": 0.30,
    "5912": 0.20,
    "5944": 0.45,
    "7801": 0.80,
    "7802": 0.75,
    "7995": 0.85,
    "4511": 0.35,
    "5311": 0.25,
    "5999": 0.50,
}
DEFAULT_MCC_RISK = 0.50

DIMS = 14
SCALE_I16 = 10000.0
#: Dimensions that may hold the sentinel -1, and their weight in the 8-bit distance.
SENTINEL_DIMS = (5, 6)
SENTINEL_WEIGHT = 4

# Search.
NEIGHBOURS = 5
NLOW, NHIGH = 8, 128
#: A transaction is denied from a score of 0.6, that is from three fraudulent neighbours of five.
DENIED_FROM = 3
RESPONSES = [
    '{"approved":true,"fraud_score":0.0}',
    '{"approved":true,"fraud_score":0.2}',
    '{"approved":true,"fraud_score":0.4}',
    '{"approved":false,"fraud_score":0.6}',
    '{"approved":false,"fraud_score":0.8}',
    '{"approved":false,"fraud_score":1.0}',
]

# Index format.
INDEX_VERSION = 5

# Evaluation.
TEST_SET_SIZE = 54100
FALSE_NEGATIVE_COST = 3
MOST_FAILURES = 0.15
LEAST_EPSILON = 0.001
FLOOR_SCORE = -3000.0
MOST_P99_MS = 2000.0
