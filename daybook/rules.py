"""Fixed values shared by every operator: limits, word lists, lookup tables and patterns.

Everything below is a fixed value: results are only right if these are exactly
as written.  No other module holds a pattern or a word list.

Two spelling notes.  Word edges are spelled with look-around on letters, digits and
underscore, because the JVM's ``\\w`` and ``\\b`` do not cover the same
characters on every release.  White space is spelled as ``SPACE`` for the same
reason: it must include the four ASCII separator controls.
"""

# --- fixed values: limits ----------------------------------------------------
MAX_MESSAGE_CHARS = 500
MAX_COMMITS_PER_REPO = 200
MAX_RESPONSE_CHARS = 8000
MAX_REPOS = 20
MAX_CUSTOM_TEMPLATES = 10
MAX_LOOKBACK_HOURS = 720
WEEK_HOURS = 168
DEFAULT_LOOKBACK_HOURS = 24
MAX_HISTORY_LISTING = 100
MAX_HISTORY_ROWS = 365
MAX_STORED_CHARS = 4000
MAX_TEMPLATE_CHARS = 2000
MAX_RENDERED_CHARS = 10000
MAX_VALUE_CHARS = 5000
MAX_LOG_TAIL = 500
USAGE_DAYS_KEPT = 30
DEFAULT_COOLDOWN_MINUTES = 30
DEFAULT_CALLS_PER_DAY = 10
MAX_ATTEMPTS = 3
STALE_AFTER_MINUTES = 60
STALE_LOOKBACK_ROWS = 25
WARN_SIZE_BYTES = 5 * 1024 * 1024
FAIL_SIZE_BYTES = 20 * 1024 * 1024

# --- fixed values: characters ------------------------------------------------
# Every character Unicode text processing treats as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
SPACE_SET = r"\t-\r\x1c-\x20\x85\xa0  -     　"
SPACE = f"[{SPACE_SET}]"
NOT_SPACE = f"[^{SPACE_SET}]"
NOT_LINE_BREAK = r"[^\n\r\x0b\x0c\x1c-\x1e\x85  ]"

WORD = r"[\p{L}\p{N}_]"
WORD_START = rf"(?<!{WORD})"  # in front of a word character
WORD_END = rf"(?!{WORD})"  # behind a word character
WORD_EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# --- fixed values: commit types ----------------------------------------------
# key, emoji, label
COMMIT_TYPES = (
    ("feat", "✨", "Feature"),
    ("fix", "\U0001f41b", "Bug Fix"),
    ("refactor", "", "Refactor"),
    ("test", "", "Tests"),
    ("docs", "", "Docs"),
    ("chore", "", "Chore"),
    ("ci", "", "CI/CD"),
    ("perf", "", "Performance"),
    ("style", "", "Style"),
    ("revert", "", "Revert"),
    ("merge", "", "Merge"),
    ("wip", "", "WIP"),
    ("unknown", "", "Other"),
)
UNKNOWN_TYPE = "unknown"

CONVENTIONAL_PREFIX = (
    r"(?iu)^(feat|fix|refactor|test|docs|chore|ci|perf|style|revert)(?:\([^)]+\))?!?:"
)

# type, pattern; the first that matches anywhere decides
TYPE_HINTS = (
    ("merge", rf"^(?:merge|merged){WORD_END}"),
    ("wip", rf"^wip{WORD_END}|work in progress"),
    ("revert", rf"^(?:revert|rollback){WORD_END}"),
    ("ci", rf"{WORD_START}(?:ci|cd|workflow|github actions|pipeline){WORD_END}"),
    ("docs", rf"{WORD_START}(?:doc|docs|readme|changelog|comment){WORD_END}"),
    ("test", rf"{WORD_START}(?:test|tests|spec|pytest|unittest){WORD_END}"),
    ("refactor", rf"{WORD_START}(?:refactor|cleanup|simplify|restructure){WORD_END}"),
    ("perf", rf"{WORD_START}(?:perf|performance|optimi[sz]e|faster){WORD_END}"),
    ("style", rf"{WORD_START}(?:style|format|lint|prettier|black|whitespace){WORD_END}"),
    ("fix", rf"{WORD_START}(?:fix|bug|hotfix|patch|resolve){WORD_END}"),
    (
        "feat",
        rf"{WORD_START}(?:add|adds|added|implement|implements|implemented|create|introduce|feature)"
        rf"{WORD_END}",
    ),
    (
        "chore",
        rf"{WORD_START}(?:chore|deps|dependency|dependencies|bump|release|maintenance){WORD_END}",
    ),
)

NOISE = (
    r"^merge (?:branch|pull request|remote)",
    rf"^wip{WORD_END}",
    r"^bump version",
    r"^\p{Nd}+\.\p{Nd}+\.\p{Nd}+$",
    r"^update (?:changelog|readme)$",
    r"^initial commit$",
    r"^fixup!",
    r"^squash!",
)

# --- fixed values: redaction -------------------------------------------------
REDACTED = "[REDACTED]"

# replacement, pattern; applied in this order, each on what the one before left
REDACTIONS = (
    (
        "[REDACTED]",
        r"(?iu)(?:password|passwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key"
        rf"|private[_-]?key|auth[_-]?token){SPACE}*[=:]{SPACE}*"
        rf"(?:\"[^\"]*\"|'[^']*'|{NOT_SPACE}+)",
    ),
    (
        "[REDACTED]",
        rf"{WORD_START}(?:10\.\p{{Nd}}{{1,3}}\.\p{{Nd}}{{1,3}}\.\p{{Nd}}{{1,3}}"
        r"|172\.(?:1[6-9]|2\p{Nd}|3[01])\.\p{Nd}{1,3}\.\p{Nd}{1,3}"
        rf"|192\.168\.\p{{Nd}}{{1,3}}\.\p{{Nd}}{{1,3}}){WORD_END}",
    ),
    (
        "[REDACTED]",
        rf"(?iu){WORD_START}{WORD}[\p{{L}}\p{{N}}_.-]+\.(?:local|internal|corp|lan){WORD_END}",
    ),
    ("[REDACTED]", rf"(?iu)bearer{SPACE}+[A-Za-z0-9\-._~+/]+=*"),
    (
        "[REDACTED:GITHUB_TOKEN]",
        rf"{WORD_START}ghp_[A-Za-z0-9]{{36}}{WORD_END}"
        rf"|{WORD_START}github_pat_[A-Za-z0-9_]{{20,}}{WORD_END}",
    ),
    (
        "[REDACTED:API_KEY]",
        rf"{WORD_START}sk-(?:ant-api03-|proj-)?[A-Za-z0-9_-]{{20,}}{WORD_EDGE}",
    ),
    ("[REDACTED:GROQ_KEY]", rf"{WORD_START}gsk_[A-Za-z0-9_-]{{10,}}{WORD_EDGE}"),
    ("[REDACTED:AWS_KEY]", rf"{WORD_START}(?:AKIA|ASIA)[0-9A-Z]{{16}}{WORD_END}"),
    ("[REDACTED:SLACK_TOKEN]", rf"{WORD_START}xox[baprs]-[A-Za-z0-9-]{{10,}}{WORD_EDGE}"),
    (
        "[REDACTED:URI_CREDENTIALS]",
        rf"{WORD_START}[a-zA-Z][a-zA-Z0-9+.-]*://[^{SPACE_SET}:@/]+:[^{SPACE_SET}@/]+@",
    ),
)

# What a text must contain for the rule in the same place to match at all: one entry of
# every group.  "~" looks in the lower-cased text.  The long s and the dotless and
# dotted i are there because matching without case takes them for s and i.
REDACTION_CLUES = (
    (("=", ":"), ("~pass", "~secret", "~token", "~key", "\u017f")),
    (("10.", "172.", "192.168."),),
    (("~.local", "~.internal", "~.corp", "~.lan", "\u0131", "\u0130"),),
    (("~bearer",),),
    (("ghp_", "github_pat_"),),
    (("sk-",),),
    (("gsk_",),),
    (("AKIA", "ASIA"),),
    (("xox",),),
    (("://",),),
)

# --- fixed values: error texts -----------------------------------------------
UNEXPECTED_ERROR = "An unexpected error occurred."
ERROR_SENTENCES = (
    ("FileNotFoundError", "A required file or directory could not be found."),
    (
        "PermissionError",
        "Permission was denied while accessing a required file or directory.",
    ),
    ("TimeoutError", "The operation timed out."),
    ("JSONDecodeError", "Invalid JSON content was encountered."),
    ("sqlite3.Error", "The local history database could not be accessed safely."),
)
ERROR_REDACTIONS = (
    r"[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*+[^\\/:*?\"<>|\r\n]*",
    rf"(?:/home/|/Users/)[^/{SPACE_SET}]+(?:/{NOT_SPACE}*)?",
    rf"[^@{SPACE_SET}]+@[^@{SPACE_SET}]+\.[^@{SPACE_SET}]+",
    r"gsk_[A-Za-z0-9_\-]{10,}",
)
MAX_ERROR_CHARS = 200

# --- fixed values: log field names -------------------------------------------
SAFE_LOG_KEYS = (
    "cached",
    "commit_count",
    "duration_ms",
    "event",
    "health_score",
    "level",
    "model",
    "operation",
    "passed",
    "provider",
    "python_version",
    "quality_score",
    "repos",
    "seconds_remaining",
    "success",
    "tone",
    "version",
    "warned",
    "failed",
)
SENSITIVE_LOG_KEYS = (
    "author_email",
    "commit_message",
    "error_message",
    "file_path",
    "llm_output",
    "prompt",
    "standup_text",
    "template_content",
)
SENSITIVE_LOG_FRAGMENTS = (
    "key",
    "secret",
    "password",
    "token",
    "api",
    "email",
    "template",
    "prompt",
    "standup_text",
    "output",
    "path",
)

# --- fixed values: templates -------------------------------------------------
TEMPLATE_VARIABLES = (
    "yesterday",
    "today",
    "blockers",
    "date",
    "time",
    "commit_count",
    "repos",
    "provider",
    "author_email",
)
TEMPLATE_TOKEN = r"\{([a-z_][a-z0-9_]*)\}"
TEMPLATE_FORBIDDEN = r"\{[^{}]*[!:.][^{}]*\}"
TEMPLATE_NAME = r"^[A-Za-z0-9_-]{1,50}\n?\z"
# The line that signs the "slack" body names the tool that made the text; here
# that name is the {generator} argument of ``builtin_templates``.
BUILTIN_TEMPLATES = (
    ("default", "**Yesterday:** {yesterday}\n\n**Today:** {today}\n\n**Blockers:** {blockers}"),
    (
        "slack",
        ":wave: *Daily Standup — {date}*\n\n*Yesterday:* {yesterday}\n*Today:* {today}\n"
        "*Blockers:* {blockers}\n\n"
        "_Generated by %(generator)s | {provider} | {commit_count} commit(s) across {repos}_",
    ),
    ("minimal", "{yesterday} | {today} | {blockers}"),
    (
        "detailed",
        "# Standup — {date} {time}\n\n## Yesterday\n{yesterday}\n\n## Today\n{today}\n\n"
        "## Blockers\n{blockers}\n\n---\n"
        "_Commits: {commit_count} | Repos: {repos} | Provider: {provider}_",
    ),
    (
        "jira",
        "[Standup {date}]\nDone: {yesterday}\nDoing: {today}\nImpediments: {blockers}",
    ),
)

# section, words that open it, words that close it
SECTIONS = (
    (
        "yesterday",
        "yesterday|done|completed|what i did|last|worked on",
        "today|doing|planning|next|blockers|impediment",
    ),
    (
        "today",
        "today|doing|planning|next|working on|will do",
        "blockers|impediment|blocker|yesterday|done",
    ),
    (
        "blockers",
        "blockers?|impediments?|blocked|stuck|challenges?|risks?|help needed",
        "yesterday|today|done|doing",
    ),
)
FALLBACK_SECTION_CHARS = 500

# --- fixed values: prompts ---------------------------------------------------
PROMPT_OPENING = "Here is my recent git activity:\n\n"
PROMPT_REQUEST = (
    "\n\nPlease generate a daily standup summary from this data. "
    "Pay attention to the commit type labels so features, fixes, refactors, "
    "and supporting work are described accurately. "
)
PROMPT_CASUAL = "Use a casual, friendly tone."
PROMPT_FORMAL = "Use a formal, professional tone."
PROMPT_LAYOUT = (
    " Format it as:\n"
    "**Yesterday:** what I worked on\n"
    "**Today:** what I plan to do\n"
    "**Blockers:** any blockers (or 'None')\n"
)
RETRY_OPENING = "Please revise the standup so it fixes these quality issues:\n"
RETRY_DEFAULT = "- Improve specificity, completeness, clarity, and actionability."
RETRY_ORIGINAL = "\n\nOriginal request:\n"

# --- fixed values: settings --------------------------------------------------
TONES = ("casual", "formal")
PROVIDERS = ("ollama", "groq")
EMAIL = rf"(?d)^[^@{SPACE_SET}]+@[^@{SPACE_SET}]+\.[^@{SPACE_SET}]+$"
WEBHOOK_PREFIX = "https://hooks.slack.com/"
BASE_URL = rf"(?d)^https?://[^{SPACE_SET}/$.?#].{NOT_SPACE}*$"
API_KEY_PREFIX = "gsk_"
API_KEY_MIN_CHARS = 40
TRUE_WORDS = ("true", "yes", "y", "1")
INTEGER = r"^[+-]?\p{Nd}+(?:_\p{Nd}+)*\z"

# --- fixed values: usage report ----------------------------------------------
BARS = "▁▂▃▄▅▆▇█"
