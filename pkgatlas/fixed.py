"""Values that results depend on, in one place.

FIXED VALUES: thresholds, word lists, labels and formats that an answer must match.
Everything here is only a default; the operators take each as a parameter.
"""

# Health score: points per unit, recency bands (days -> points), risk and label bands.
ADOPTION_FACTOR = 25
COMMUNITY_FACTOR = 30
MATURITY_PER_VERSION = 3
MAINTENANCE_BANDS = ((30, 100), (90, 80), (180, 60), (365, 40), (730, 20))
MAINTENANCE_FLOOR = 5
SCORE_LABELS = ((80, "healthy"), (60, "moderate"))
SCORE_LABEL_FLOOR = "caution"
SCORE_COLORS = ((80, "#22c55e"), (60, "#eab308"))
SCORE_COLOR_FLOOR = "#ef4444"
RISK_LEVELS = ((40, "high"), (70, "moderate"))
RISK_LEVEL_CEILING = "low"
UNKNOWN_DAYS = 9999

RISK_STALE_1Y = "No release in over a year"
RISK_STALE_2Y = "No release in over 2 years — possibly abandoned"
RISK_ADOPTION = "Very low adoption (< 10 dependents)"
RISK_COMMUNITY = "Low community engagement (< 50 stars)"
RISK_RELEASES = "Very few releases — may be immature"

# Our own weights and blend (the originals are not public).
SCORE_WEIGHTS = {"adoption": 0.40, "maintenance": 0.30, "community": 0.20, "maturity": 0.10}
BLEND_WEIGHTS = {"similarity": 0.60, "popularity": 0.25, "growth": 0.15}

# Ranking thresholds.
GROWTH_MIN_PCT = 50
GROWTH_MIN_DEPENDENTS = 50
GROWTH_MIN_DEPENDENTS_WITHOUT_STARS = 500
QUALITY_MIN_DEPENDENTS = 200
QUALITY_MIN_STARS = 500
SEARCH_MIN_DEPENDENTS = 100
SEARCH_SCORE_THRESHOLD = 0.3
TIER1_GROWTH, TIER1_LIMIT = 50, 100
TIER2_GROWTH, TIER2_LIMIT = 200, 150

# Query matching. The original key ends at so many characters; the whole question is the default.
QUERY_KEY_CHARS = 80
MATCH_MIN_WORDS = 3
MATCH_MIN_SHARED = 4
STOP_WORDS = (
    "a", "an", "the", "is", "are", "for", "in", "of", "to", "and", "or",
    "what", "how", "do", "does", "vs", "best", "top",
)

# Query intent.
GROWTH_STEMS = (
    "grow", "trend", "rising", "fastest", "hottest", "explod", "surge", "boom", "emerging",
)
GROWTH_STEMS_SEARCH_ONLY = ("popular",)
DOMAIN_WORDS = (
    "orm", "database", "web.?scrap", "test", "auth", "http", "api", "async", "queue",
    "cache", "log", "email", "csv", "excel", "pdf", "image", "video", "cli", "gui",
)
TOPIC_TERMS = (
    "machine learning", "deep learning", "language model", "llm", "transformer",
    "embedding", "vector", "agent",
)

# Download documents.
DOWNLOAD_CATEGORY = "without_mirrors"

# README code blocks.
INSTALL_COMMANDS = ("pip install", "python -m pip install")
SKIPPED_FENCE_TAGS = (
    "html", "xml", "css", "json", "yaml", "yml", "toml", "ini",
    "console", "bash", "sh", "shell", "sql",
)

# Display bands.
TREND_BAND = 5
RECENCY_STATUS = ((90, "green"), (365, "amber"))
RECENCY_STATUS_FLOOR = "red"
VERSION_BANDS = (10, 3)
STAR_BANDS = (1000, 100)
DEPENDENT_BANDS = (100, 10)
REGISTRY_URL = "https://pypi.org/project/"
REPOSITORY_HOST = "https://github.com/"
