"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is a FIXED VALUE: thresholds, weights, word
lists, palettes and lookup tables whose exact content decides results.
They are written out plainly, in their natural order.
"""

from __future__ import annotations

# --- FIXED VALUES: supplier table -------------------------------------------

SUPPLIER_COLUMNS = (
    "supplier_id", "supplier_name", "risk_score", "latitude", "longitude",
    "region", "tier", "annual_spend_usd", "last_audit_date",
)
STRING_COLUMNS = ("supplier_id", "supplier_name", "region", "last_audit_date")
DOUBLE_COLUMNS = ("risk_score", "latitude", "longitude", "annual_spend_usd")
INT_COLUMNS = ("tier",)
# Columns whose inner whitespace is removed entirely (the name keeps it).
DESPACE_COLUMNS = ("supplier_id", "region", "last_audit_date")
# Tokens turned into null after trimming; case-sensitive.
NULL_TOKENS = ("NULL", "null", "N/A", " ", "")

REGIONS = ("EMEA", "APAC", "NA", "LATAM")

# Unicode White_Space (the set Java's (?U)\s and Rust's is_whitespace use):
# tab..carriage return, space, NEL, NBSP, OGHAM SPACE MARK, EN QUAD..HAIR
# SPACE, LINE/PARAGRAPH SEPARATOR, NARROW NBSP, MEDIUM MATH SPACE,
# IDEOGRAPHIC SPACE.
WHITESPACE = "".join(
    [chr(c) for c in range(0x09, 0x0E)] + ["\u0020", "\u0085", "\u00a0", "\u1680"]
    + [chr(c) for c in range(0x2000, 0x200B)]
    + ["\u2028", "\u2029", "\u202f", "\u205f", "\u3000"])

# --- FIXED VALUES: scoring --------------------------------------------------

COMPONENTS = (
    "component_base",
    "component_financial",
    "component_operational",
    "component_geopolitical",
    "component_audit_staleness",
)
# (base, financial, operational, geopolitical, audit staleness)
WEIGHTS = {
    "balanced": (0.25, 0.25, 0.25, 0.15, 0.10),
    "financial_heavy": (0.15, 0.45, 0.15, 0.15, 0.10),
    "operational_heavy": (0.15, 0.15, 0.45, 0.15, 0.10),
    "geopolitical_heavy": (0.15, 0.15, 0.15, 0.45, 0.10),
}
GEO_RISK = {"EMEA": 0.8, "APAC": 0.7, "LATAM": 0.6}
GEO_RISK_DEFAULT = 0.3
STALENESS_DAYS = 730.0
NULL_TIER = 4.0

# --- FIXED VALUES: bands and colours ----------------------------------------

# Lower bounds, checked from the top; below the last bound is LOW.
BANDS = (("CRITICAL", 0.85), ("HIGH", 0.70), ("MEDIUM", 0.40))
BAND_ORDER = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
RISK_RGB = {
    "LOW": (52, 211, 153),
    "MEDIUM": (250, 204, 21),
    "HIGH": (167, 139, 250),
    "CRITICAL": (244, 63, 94),
}
RGB_ALPHA = 210
RADIUS_BASE = 60_000.0
RADIUS_SCALE = 240_000.0
HIGH_RISK = 0.70
CRITICAL_RISK = 0.85

# --- FIXED VALUES: scenario bounds ------------------------------------------

SCENARIO_NAME_MAX = 100
MAP_POINTS_DEFAULT = 50_000
MAP_POINTS_MAX = 250_000

# --- FIXED VALUES: map defaults ---------------------------------------------

DEFAULT_ENTITY_ID = "ENTITY"
DEFAULT_ENTITY_NAME = "Unknown Entity"
DEFAULT_REGION = "-"

# --- FIXED VALUES: HTML escaping, ampersand first ---------------------------

HTML_ESCAPES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#39;"),
)

# --- FIXED VALUES: weather --------------------------------------------------

# (level, wind km/h lower bound, precipitation % lower bound), checked in order.
SHIPPING_RISK = (
    ("SEVERE", 80.0, 80.0),
    ("HIGH", 50.0, 60.0),
    ("MODERATE", 30.0, 40.0),
)
SHIPPING_RISK_DEFAULT = "LOW"
# Fill values for missing hourly measurements.
WEATHER_DEFAULTS = {"wind": 0.0, "precip": 0.0, "temp": 20.0, "code": 0}
CONDITION_UNKNOWN = "Unknown"
WEATHER_CONDITIONS = {
    0: "Clear sky",
    1: "Mostly clear",
    2: "Partly cloudy",
    3: "Overcast",
    45: "Fog",
    48: "Depositing rime fog",
    51: "Light drizzle",
    53: "Moderate drizzle",
    55: "Dense drizzle",
    56: "Light freezing drizzle",
    57: "Dense freezing drizzle",
    61: "Light rain",
    63: "Moderate rain",
    65: "Heavy rain",
    66: "Light freezing rain",
    67: "Heavy freezing rain",
    71: "Light snow",
    73: "Moderate snow",
    75: "Heavy snow",
    77: "Snow grains",
    80: "Light rain showers",
    81: "Moderate rain showers",
    82: "Violent rain showers",
    85: "Light snow showers",
    86: "Heavy snow showers",
    95: "Thunderstorm",
    96: "Thunderstorm with slight hail",
    99: "Thunderstorm with heavy hail",
}

# --- FIXED VALUES: error classification -------------------------------------

CAT_QUOTA = "CAT_QUOTA"
CAT_TIMEOUT = "CAT_TIMEOUT"
CAT_AUTH = "CAT_AUTH"
CAT_SCHEMA = "CAT_SCHEMA"
CAT_FALLBACK = "CAT_FALLBACK"
# Typed HTTP status first.
STATUS_CATEGORIES = (
    (CAT_QUOTA, (429,)),
    (CAT_AUTH, (401, 403)),
    (CAT_TIMEOUT, (502, 503, 504)),
)
# Then substrings of the lower-cased message, in this order.
MESSAGE_CATEGORIES = (
    (CAT_QUOTA, ("429", "quota", "rate_limit", "rate limit")),
    (CAT_TIMEOUT, ("504", "timeout", "deadline", "timed out")),
    (CAT_AUTH, ("401", "403", "auth", "api_key", "unauthorized")),
    (CAT_SCHEMA, ("schema", "validation", "pydantic")),
)
RETRYABLE_STATUS = (429, 502, 503)

# --- FIXED VALUES: news -----------------------------------------------------

UNTITLED = "Untitled"
NEWS_TTL_SECONDS = 900
NEWS_LIMIT = 25
# Feed name -> URL; an unknown name is used as its own URL.
FEED_SOURCES = {
    "Supply Chain Dive": "https://www.supplychaindive.com/feeds/news/",
    "Logistics Management": "https://www.logisticsmgmt.com/rss/feed",
    "FreightWaves": "https://www.freightwaves.com/news/feed",
    "DC Velocity": "https://www.dcvelocity.com/rss/feed",
    "JOC": "https://www.joc.com/rss.xml",
    "Hellenic Shipping News": "https://www.hellenicshippingnews.com/feed/",
    "Reuters Trade": "https://www.reutersagency.com/feed/?best-topics=business-finance&post_type=best",
    "Bloomberg Supply Chain": "https://feeds.bloomberg.com/markets/news.rss",
}

# --- FIXED VALUES: narratives and prompts -----------------------------------

MAX_INPUT_TOKENS = 10_000
CHARS_PER_TOKEN = 4
NARRATIVE_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
# Severity order for narrative ranking; anything else ranks after these.
SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
SEVERITY_OTHER = 9
MAX_KEY_RISKS = 3
MAX_DISRUPTIONS = 5
UNKNOWN_SUPPLIER = "UNKNOWN"
NARRATIVE_PROMPT = """
You are an elite supply chain risk analyst. Evaluate the following supplier data
and return a JSON array of RiskNarrative objects.

For every object, echo the exact supplier_id from the input row so results can
be matched deterministically.

Strictly adhere to the response_schema. Do not include markdown or conversational text.

Suppliers:
"""

DIGEST_PROMPT_HEAD = """
You are an elite supply chain intelligence analyst. Synthesize the following
live news items into a single NewsDigest object.

Strictly adhere to the response_schema. No markdown, no commentary.

News items:
"""

# --- FIXED VALUES: logs -----------------------------------------------------

LOG_ID_KEYS = ("request_id", "supplier_id", "batch_id")
LOG_LEVEL_WIDTH = 8
LOG_LEVELS_SHOWN = ("INFO", "SUCCESS", "WARNING", "ERROR", "CRITICAL")
LOG_BUFFER = 1000

# --- FIXED VALUES: report text folding (latin-1 safe) -----------------------

FOLD_REPLACEMENTS = (
    ("—", "-"),
    ("–", "-"),
    ("’", "'"),
    ("‘", "'"),
    ("“", '"'),
    ("”", '"'),
    ("≥", ">="),
    ("≤", "<="),
    ("·", "-"),
    ("…", "..."),
    ("→", "->"),
    ("€", "EUR "),
    ("£", "GBP "),
    ("₹", "Rs "),
)
REPORT_ID_WIDTH = 22
REPORT_NAME_WIDTH = 40
REPORT_REGION_WIDTH = 16
TOP_RISKS = 10
TOP_NARRATIVES = 5
