"""Results only match when these lists are exactly these, in this order."""

# --- identities -------------------------------------------------------------------------------
BOT_MARKERS = [
    "[bot]", "dependabot", "renovate", "github-actions", "claude", "codex", "cursor", "devin",
    "copilot",
]

# --- files ------------------------------------------------------------------------------------
DOC_EXTENSIONS = [".md", ".mdx", ".rst", ".txt", ".adoc"]

CONFIG_EXTENSIONS = [
    ".yml", ".yaml", ".toml", ".ini", ".cfg", ".conf", ".properties", ".json", ".xml",
]

LANGUAGE_OF_EXTENSION = {
    ".py": "Python",
    ".java": "Java",
    ".js": "JavaScript",
    ".jsx": "JavaScript",
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".go": "Go",
    ".rb": "Ruby",
    ".rs": "Rust",
    ".kt": "Kotlin",
    ".kts": "Kotlin",
    ".scala": "Scala",
    ".c": "C",
    ".cc": "C++",
    ".cpp": "C++",
    ".cxx": "C++",
    ".h": "C/C++ Header",
    ".hpp": "C/C++ Header",
}

LOCKFILE_NAMES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "cargo.lock", "pdm.lock",
    "composer.lock", "gradle.lockfile",
]

GENERATED_MARKERS = [
    "/vendor/", "/vendors/", "/node_modules/", "/dist/", "/build/", "/generated/",
    "/__generated__/", ".min.js", ".min.css",
]

TEST_MARKERS = [
    "/test/", "/tests/", "/testing/", "/__tests__/", "test_", "_test.", "tests.py", "spec/",
]

DOC_MARKERS = ["/docs/", "/doc/", "readme", "changelog", "license", "notice"]

CONFIG_MARKERS = [".github/", ".gitlab/", "docker-compose", "pyproject.toml", "setup.cfg"]

TARGET_LANGUAGES = ["Java", "Python"]

# --- hunks ------------------------------------------------------------------------------------
# One character of an identifier start, or one of the listed brackets and signs, makes a hunk
# code-like.
CODE_LIKE = r"[A-Za-z_{}();=\[\].]"

LENGTH_BUCKETS = [("very_short", 5), ("short", 15), ("medium", 40), ("long", None)]

# --- calibration ------------------------------------------------------------------------------
# The grid 0.30..0.80 in steps of 0.05 as double arithmetic leaves it; 0.45 itself is not in it.
THRESHOLD_GRID = [
    0.3, 0.35, 0.39999999999999997, 0.44999999999999996, 0.49999999999999994, 0.5499999999999999,
    0.5999999999999999, 0.6499999999999999, 0.7, 0.7499999999999999, 0.7999999999999998,
]

BAND_OFFSET = 0.10
BAND_CEILING = 0.99

MIN_STRATUM_ROWS = 20
FROZEN_MIN_SUPPORT = 25
FROZEN_MIN_BALANCED_ACCURACY = 0.60
FROZEN_MAX_FALSE_POSITIVE_RATE = 0.35

MAIN_FILE_CATEGORIES = ["source", "test"]
EXCLUDED_FILE_CATEGORIES = ["docs", "config", "lockfile"]
EXCLUDED_LENGTH_BUCKETS = ["very_short"]

# --- message study ----------------------------------------------------------------------------
# (first year, last year, factor); products above 1 are cut to 1.
YEAR_FACTORS = [(None, 2020, 0.10), (2021, 2021, 0.40), (2022, 2022, 0.85), (2023, None, 1.3)]
AI_FLAG_ABOVE = 0.5

PRE_PERIOD = "2021-2022 pre-mainstream LLM"
POST_PERIOD = "2023-2025 post-mainstream LLM"
LAST_PRE_YEAR = 2022
FIRST_TREND_YEAR = 2021
FIRST_TREND_MONTH = "2021-01"

# --- text corpora -----------------------------------------------------------------------------
SEPARATOR = "<<<SEP>>>"

PROMPT_TAGS = ["[ WP ]", "[ OT ]"]

# Applied one after the other, in this order.
STORY_REPLACEMENTS = [
    (" ,", ","),
    (" .", "."),
    (" ?", "?"),
    (" !", "!"),
    (" ;", ";"),
    (" '", "'"),
    (" ’ ", "'"),
    (" :", ":"),
    ("<newline>", "\n"),
    ("`` ", '"'),
    (" ''", '"'),
    ("''", '"'),
    (".. ", "... "),
    (" )", ")"),
    ("( ", "("),
    (" n't", "n't"),
    (" i ", " I "),
    (" i'", " I'"),
    ("\\'", "'"),
    ("\n ", "\n"),
]

REJECTED_STORY_WORDS = ["nsfw", "NSFW"]

MASK_PREFIX = "<extra_id_"
MASK_PATTERN = r"<extra_id_\d+>"
GENERATOR_MARKS = ["<pad>", "</s>"]
