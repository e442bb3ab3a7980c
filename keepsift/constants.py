"""Fixed values the results depend on."""

# Six score dimensions, in the order they are summed.
DIMENSIONS = ("quality", "aesthetic", "composition", "sharpness", "exposure", "faceEyes")

# Weights per genre; every row sums to 100. Order of numbers: DIMENSIONS.
GENRE_PRESETS = {
    "general": (25, 20, 15, 15, 10, 15),
    "wedding": (20, 20, 10, 15, 10, 25),
    "portrait": (20, 15, 10, 15, 10, 30),
    "sports": (25, 15, 10, 30, 10, 10),
    "landscape": (25, 25, 20, 15, 15, 0),
    "street": (20, 25, 20, 15, 10, 10),
    "event": (20, 15, 10, 20, 10, 25),
}

# USD per million tokens: (input, output).
PROVIDER_PRICES = {
    "claude": (3.0, 15.0),
    "openai": (2.0, 8.0),
    "gemini": (1.5, 9.0),
    "ollama": (0.0, 0.0),
    "custom": (0.0, 0.0),
}

# Provider -> (base url, default model).
PROVIDER_DEFAULTS = {
    "claude": ("", "claude-sonnet-4-6"),
    "openai": ("https://api.openai.com/v1", "gpt-4.1"),
    "gemini": ("https://generativelanguage.googleapis.com/v1beta/openai", "gemini-3.5-flash"),
    "ollama": ("http://localhost:11434/v1", "llava"),
    "custom": ("", ""),
}

# Licence tiers: monthly limit (None = unlimited) and rank; features and the tier they need.
TIER_LIMITS = {"free": 500, "pro": 5000, "lifetime": None}
TIER_RANKS = {"free": 0, "pro": 1, "lifetime": 2}
FEATURE_TIERS = {
    "rawFormats": "pro",
    "xmpExport": "pro",
    "unlimitedImages": "pro",
    "unlimitedProfiles": "pro",
    "autoTagging": "pro",
}
FREE_PROFILE_LIMIT = 2

STANDARD_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".webp", ".heic", ".heif", ".gif", ".avif", ".tiff", ".tif",
)
RAW_EXTENSIONS = (
    ".cr2", ".cr3", ".nef", ".nrw", ".arw", ".sr2", ".raf", ".dng", ".orf", ".rw2", ".pef", ".3fr",
)
SUPPORTED_EXTENSIONS = STANDARD_EXTENSIONS + RAW_EXTENSIONS

# Names never listed (dot names are hidden anyway) and directories never entered.
JUNK_NAMES = (".DS_Store", "Thumbs.db")
SKIPPED_DIRS = ("node_modules", ".git")

# Tiers.
TIERS = ("S", "A", "B", "rejected")
TIER_SHARES = {"S": 0.10, "A": 0.30, "B": 0.30}
QUALITY_FLOOR = 30
TIER_RATINGS = {"S": 5, "A": 4, "B": 3, "rejected": 1}
TIER_LABELS = {"S": "Green", "A": "Blue", "B": "Yellow", "rejected": "Red"}

# Similarity, faces, sampling, tagging, retries, estimates.
DEFAULT_DUPLICATE_THRESHOLD = 10
BLINK_THRESHOLD = 0.3
MIN_FACE_IMAGE_PX = 64
SAMPLE_SHARE, SAMPLE_MIN, SAMPLE_MAX = 0.05, 5, 8
TAG_BLOCK = 5
TAG_TOP_PERCENT = 20
MAX_SERVER_RETRIES = 3
SERVER_BACKOFF_SECONDS = 1
DEFAULT_RETRY_AFTER = 60
#: Seconds that a scoring call, a call for several files and a detection may take.
CALL_LIMIT_S, BLOCK_LIMIT_S, DETECT_LIMIT_S = 30, 60, 30
TOKENS_PER_ITEM = (800, 200)
UNKNOWN_ITEM_MS = 5000
CLOCK_TOLERANCE_SECONDS = 3600
HISTORY_KEEP_ON_APPEND = 10
HISTORY_KEEP_ON_MAINTENANCE = 30
RECENT_LIMIT = 10
UNDO_LIMIT = 20
PREVIEW_MAX_PX = 1024
MAX_BASE64_BYTES = 50 * 1024 * 1024
MODEL_TTL_SECONDS = 3600
MAINTENANCE_DAYS = 7
PROGRESS_SECONDS = 5

# Model-name prefixes used by the catalogue filters.
OPENAI_VISION_PREFIXES = ("gpt-4", "gpt-5", "o1", "o3", "o4", "chatgpt-4o")
LOCAL_VISION_PREFIXES = (
    "llava", "moondream", "bakllava", "minicpm-v", "llama3.2-vision", "cogvlm", "qwen2-vl",
    "granite3-vision", "phi3.5-vision", "internvl",
)

# File-name classes of the deterministic scorer, first match wins. Scores in DIMENSIONS order.
NAME_SCORES = (
    ("good|great|excellent|amazing|perfect", (95, 93, 90, 92, 91, 96)),
    ("bad|poor|blurry|reject|dark|underexposed", (25, 20, 22, 15, 10, 20)),
    ("landscape|scenic|nature|mountain", (62, 75, 68, 60, 65, 25)),
    ("portrait|face|person", (65, 60, 62, 58, 64, 85)),
)
NAME_SCORES_DEFAULT = (60, 60, 60, 60, 60, 60)
NAME_KEYWORDS = (
    ("wedding", ("wedding", "bride", "groom", "ceremony", "candid", "emotional")),
    ("portrait|face", ("portrait", "natural light", "smile", "person", "close-up")),
    ("landscape|nature", ("landscape", "nature", "scenic", "mountain", "outdoor")),
)
NAME_KEYWORDS_DEFAULT = ("photography", "image", "photo", "capture", "session")
