"""Tunable constants of the news domain (fixed values: results depend on them)."""

WHISPERS_PER_15_MIN, WHISPERS_PER_HOUR, WHISPERS_PER_SOURCE_HOUR, WHISPERS_PER_CLUSTER_2H = 2, 5, 2, 1
COOLDOWN_MIN, QUIET_MIN = 5, 120
CALENDAR_WINDOW_HIGH, CALENDAR_WINDOW_MEDIUM = 60, 30
CLUSTER_WHISPER, CLUSTER_GLOW = 3, 2
CONFIRM_HIGH, CONFIRM_MEDIUM, CONFIRM_OTHER, PROXIMITY_MIN = 30, 60, 120, 120
TITLE_WINDOW_MS = 6 * 3600 * 1000
TRACKING_PARAMETERS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid"]
MACRO_KEYWORDS = ["fomc", "cpi", "nfp", "powell", "ecb", "boj", "jobless", "pmi", "gdp"]
USABLE_PROVENANCE = ["deterministic", "user_confirmed"]
PROMOTABLE_TIERS = ["verified", "reported", "scheduled"]
RETRY_ATTEMPTS, RETRY_BASE_MS, RETRY_FACTOR, RETRY_CAP_MS = 3, 1000, 2, 30000
PRICE_IN, PRICE_CACHED, PRICE_OUT = "0.4", "0.1", "1.6"
SNIPPET = 240
CLUSTER_RULE, WHISPER_RULE = "cluster-rule-v1", "whisper-rule-v1"
