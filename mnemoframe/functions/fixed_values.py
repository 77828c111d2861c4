"""Word lists, tables, patterns and constants that results depend on."""

# --- scoring constants -----------------------------------------------------
HALF_LIFE_DAYS = 30.0
FREQUENCY_NORM = 50.0
RERANK_WEIGHT = 0.4
FETCH_MULTIPLIER = 3
DEFAULT_LIMIT = 10
COMPOUND_MIN_SIMILARITY = 0.25
ENTITY_MIN_SIMILARITY = 0.3
DEDUP_MIN_SIMILARITY = 0.55
DEDUP_MATCHES = 5
DEFAULT_DEPTH = 2
DEFAULT_ENTITIES = 200
BM25_K1 = 1.2
BM25_B = 0.75
SEGMENT_CHARS = 800
SEGMENTS_BEFORE = 2
SEGMENTS_AFTER = 1
FLUSH_MESSAGES = 5
FLUSH_IDLE_SECONDS = 30
SESSION_GAP_MINUTES = 30
SCRATCHPAD_CHARS = 5000

SIGNALS = ("vector", "keyword", "graph", "recency", "salience", "temporal")
DEFAULT_WEIGHTS = {
    "vector": 0.30, "keyword": 0.15, "graph": 0.15,
    "recency": 0.10, "salience": 0.10, "temporal": 0.20,
}

# --- enumerations ----------------------------------------------------------
SCOPES = ("user", "agent", "session", "hive")
EDGE_TYPES = (
    "associative", "causal", "temporal", "contradictory", "hierarchical",
    "updates", "extends", "derives", "precedes", "depends_on", "deadline",
)
ENTITY_ROLES = ("subject", "object", "mentioned")
FEEDBACK_TYPES = (
    "implicit_positive", "implicit_negative", "explicit_positive",
    "explicit_negative", "correction",
)
PLANS = ("free", "pro", "scale", "enterprise")
PLAN_REQUESTS_PER_MINUTE = {"free": 30, "pro": 120, "scale": 600, "enterprise": 6000}
PLAN_REQUESTS_PER_DAY = {
    "free": 5000, "pro": 50000, "scale": 500000, "enterprise": 5000000,
}
EXTRACTION_STATUSES = ("queued", "processing", "completed", "failed", "deduped")
API_KEY_SCOPES = ("read", "write", "admin")

# --- word lists ------------------------------------------------------------
QUERY_STOP_WORDS = (
    "what when where who why how which "
    "is are was were did does do will can could would should have has had been be "
    "the a an in on at to for of with "
    "and or but not if still "
    "it its her his she he they them their my your our that this"
).split()

KEYWORD_STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could "
    "should may might can shall to of in for on with at by from as into through during "
    "before after above below between and but or not no nor so yet both each few more "
    "most other some such than too very just about up out if then that this these those "
    "it its user users they them their he she"
).split()

GENERIC_ENTITIES = ("user", "assistant")
LEADING_NOISE_WORDS = (
    "the a an when where how what why who is are was were has have had my our their his "
    "her its this that these those"
).split()

MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
)
MONTH_ABBREVIATIONS = (
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
)
BACKFILL_DEFAULT_YEAR = 2026

# --- lookup tables ---------------------------------------------------------
RELATION_SYNONYMS = {
    "loves_deeply": "loves",
    "has_relationship": "partner_of",
    "has_relationship_with": "partner_of",
    "dating": "partner_of",
    "in_relationship_with": "partner_of",
    "romantic_partner": "partner_of",
    "girlfriend_of": "partner_of",
    "boyfriend_of": "partner_of",
    "married_to": "partner_of",
    "works_for": "works_at",
    "employed_at": "works_at",
    "employed_by": "works_at",
    "resides_in": "lives_in",
    "located_at": "located_in",
    "friends_with": "friend_of",
    "acquainted_with": "knows",
    "knows_about": "knows",
    "interested_in": "prefers",
    "attracted_to": "prefers",
    "likes": "prefers",
    "replaces": "updates",
    "supersedes": "updates",
    "overrides": "updates",
    "corrects": "updates",
    "supplements": "extends",
    "refines": "extends",
    "elaborates": "extends",
    "details": "extends",
    "infers": "derives",
    "implies": "derives",
    "combines": "derives",
}

SIGNAL_PHRASES = (
    "remember", "don't forget", "note that", "important", "decided", "chose",
    "architecture", "design", "decision", "bug", "fix", "fixed", "solved", "solution",
    "prefer", "always", "never", "pattern", "refactor", "migrate", "tradeoff", "deploy",
    "shipped", "launched", "learned", "realized", "discovered", "turns out", "my name",
    "i am", "i'm a", "i work", "i like", "i hate",
)

RELATION_EDGE_TYPES = {
    "extends": "extends", "derives": "derives", "precedes": "precedes",
    "depends_on": "depends_on", "deadline": "deadline",
    "part_of": "hierarchical", "has_child": "hierarchical",
}

# category -> content substrings, first category that hits wins
PROFILE_CATEGORIES = (
    ("health", ("allergic", "medication", "health")),
    ("identity", ("name is", "age", "born")),
    ("work", ("works at", "job", "engineer", "company")),
    ("location", ("lives in", "based in", "location", "from")),
    ("preference", ("prefers", "likes", "loves", "hates", "favorite")),
)

FEEDBACK_STEPS = {
    "explicit_positive": 0.05, "implicit_positive": 0.05,
    "explicit_negative": -0.05, "implicit_negative": -0.05,
    "correction": -0.1,
}

# --- patterns --------------------------------------------------------------
_MONTH_WORD = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|"
    r"Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
# (kind, sentence prefix, tags, pattern)
CONTACT_PATTERNS = (
    ("email", "User's email is ", "contact,email",
     r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("phone", "User's phone number is ", "contact,phone",
     r"(?:\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}\b"),
    ("url", "User mentioned URL: ", "url", r"https?://[^\s/$.?#].[^\s]*"),
    ("date", "Mentioned date: ", "date",
     r"(?i)\b(?:\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\d{4}[/\-]\d{2}[/\-]\d{2}|"
     + _MONTH_WORD + r"\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}|"
     r"\d{1,2}(?:st|nd|rd|th)?\s+" + _MONTH_WORD + r"\s+\d{4})\b"),
    ("money", "Mentioned monetary amount: ", "money",
     r"(?i)\$\s?\d+(?:[.,]\d+)*(?:\.\d{2})?|"
     r"\b\d+(?:[.,]\d+)*(?:\.\d{2})?\s?(?:dollars?|USD|EUR|GBP|euros?|pounds?)\b"),
)

# (pattern, sentence prefix, importance, tags), first rule that matches a line wins
STATEMENT_RULES = (
    (r"(?i)\bi(?:'m| am)\s+allergic\s+to\s+(.+?)(?:[.!?]|$)",
     "User is allergic to ", 0.95, "health,allergy"),
    (r"(?i)\bi\s+have\s+(?:a\s+)?(?:allergy|allergies)\s+to\s+(.+?)(?:[.!?]|$)",
     "User is allergic to ", 0.95, "health,allergy"),
    (r"(?i)\bi\s+(?:have|suffer from|was diagnosed with)\s+(.+?)(?:[.!?]|$)",
     "User has ", 0.95, "health"),
    (r"(?i)\bmy\s+name\s+is\s+([A-Za-z][a-zA-Z\s\-']{1,40}?)(?:[.!?,]|$)",
     "User's name is ", 0.9, "identity,name"),
    (r"(?i)\bthey\s+call\s+me\s+([A-Za-z][a-zA-Z\s\-']{1,40}?)(?:[.!?,]|$)",
     "User's name is ", 0.9, "identity,name"),
    (r"(?i)\bi(?:'m| am)\s+a(?:n)?\s+(.+?)(?:[.!?]|$)",
     "User is a ", 0.85, "identity"),
    (r"\bi(?:'m| am)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)(?:[.!?,]|$)",
     "User is ", 0.85, "identity"),
    (r"(?i)\bi\s+work\s+(?:at|for)\s+(.+?)(?:[.!?]|$)",
     "User works at ", 0.8, "work,company"),
    (r"(?i)\bmy\s+(?:job|career|profession|occupation)\s+is\s+(.+?)(?:[.!?]|$)",
     "User's job is ", 0.8, "work"),
    (r"(?i)\bi\s+(?:work|am employed)\s+as\s+(?:a(?:n)?\s+)?(.+?)(?:[.!?]|$)",
     "User works as ", 0.8, "work"),
    (r"(?i)\bi\s+live\s+in\s+(.+?)(?:[.!?]|$)", "User lives in ", 0.7, "location"),
    (r"(?i)\bi(?:'m| am)\s+from\s+(.+?)(?:[.!?]|$)", "User is from ", 0.7, "location"),
    (r"(?i)\bi\s+(?:moved|relocated)\s+to\s+(.+?)(?:[.!?]|$)",
     "User moved to ", 0.7, "location"),
    (r"(?i)\bi\s+(?:really\s+)?(?:like|love|enjoy|adore)\s+(.+?)(?:[.!?]|$)",
     "User likes ", 0.6, "preference,like"),
    (r"(?i)\bmy\s+favorite\s+(?:\w+\s+)?is\s+(.+?)(?:[.!?]|$)",
     "User's favorite is ", 0.6, "preference,like"),
    (r"(?i)\bi\s+(?:really\s+)?(?:hate|dislike|can'?t stand|despise|detest)\s+(.+?)(?:[.!?]|$)",
     "User dislikes ", 0.6, "preference,dislike"),
    (r"(?i)\bi\s+(?:think|believe|feel|guess|suppose)\s+(?:that\s+)?(.+?)(?:[.!?]|$)",
     "User thinks ", 0.3, "opinion"),
)

ROLE_PREFIX = r"^[a-zA-Z_\-]+:\s*"
HTML_TAG = r"<[^>]*>"
PRIORITY_LEAD_IN = r"(?i)^User('s)?\s+(plans|added|believes|is planning|wants)\s+"

# --- files of a code tree ----------------------------------------------------
SOURCE_ENTRY_NAMES = (
    r"index\.(ts|tsx|js|jsx)$", r"main\.(ts|tsx|js|py|rs)$", r"app\.(ts|tsx|js)$",
    r"server\.(ts|tsx|js)$", r"routes?\.(ts|tsx|js)$", r"schema\.(ts|sql|prisma)$",
    r"config\.(ts|js)$", r"lib\.rs$", r"mod\.rs$",
)
SKIPPED_FOLDERS = (
    "node_modules", ".git", "dist", "build", ".next", ".turbo", ".cache",
    "coverage", ".DS_Store", "pnpm-lock.yaml", "bun.lock", "package-lock.json",
    "yarn.lock", "__pycache__", ".venv", "venv", "target",
)
SOURCE_EXTENSIONS = r"\.(ts|tsx|js|jsx|py|rs|go|java|rb|swift|kt|vue|svelte)$"
