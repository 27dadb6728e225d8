"""Vocabularies, scales, templates and default parameters.

Everything in the first block has to equal the values the feedback format is defined
with; everything in the second block is a default of this package and may be replaced
by the caller.
"""

from __future__ import annotations

from decimal import Decimal

# --------------------------------------------------------------------------
# Fixed values (must not change: results depend on their exact text and order)
# --------------------------------------------------------------------------

PAIN_POINTS = "pain_points"
FEATURE_REQUESTS = "feature_requests"
KINDS = (PAIN_POINTS, FEATURE_REQUESTS)

PAIN_POINT_CATEGORIES = (
    "Sync & Data Management",
    "Editor & Text Input",
    "Mobile Experience",
    "Performance & Speed",
    "UI/UX & Interface",
    "Import/Export & Migration",
    "Search & Organization",
    "Plugin & Extension Issues",
    "Installation & Setup",
    "Markdown & Formatting",
    "File Handling",
    "Backup & Recovery",
    "Cross-Platform Compatibility",
    "Security & Privacy",
    "Other",
)

FEATURE_REQUEST_CATEGORIES = (
    "Editor Enhancements",
    "Mobile Features",
    "Sync Improvements",
    "UI/UX Enhancements",
    "Search & Filter Features",
    "Organization & Tagging",
    "Import/Export Features",
    "Plugin & Integration",
    "Performance Optimizations",
    "Security Features",
    "Collaboration Features",
    "Customization Options",
    "Automation & Workflow",
    "Markdown Extensions",
    "Other",
)

VOCABULARY = {
    PAIN_POINTS: PAIN_POINT_CATEGORIES,
    FEATURE_REQUESTS: FEATURE_REQUEST_CATEGORIES,
}

OTHER = "Other"
CONFIDENCE_LEVELS = ("High", "Medium", "Low")
PRIORITY_SCORES = {"high": 3, "medium": 2, "low": 1}

QUADRANTS = {
    ("high", "high"): "High Impact / High Frequency",
    ("high", "low"): "High Impact / Low Frequency",
    ("low", "low"): "Low Impact / Low Frequency",
    ("low", "high"): "Low Impact / High Frequency",
}

# Line prefixes of issue templates. ``{product}`` stands for the product's own name,
# which is a parameter; entries that hold it are left out where no name is given.
BOILERPLATE_PREFIXES = (
    "### Operating system",
    "### {product} version",
    "### Desktop version info",
    "### Current behaviour",
    "### Expected behaviour",
    "### Logs",
    "_No response_",
    "Operating system",
    "{product} version",
    "Desktop version info",
    "Current behaviour",
    "Expected behaviour",
    "Logs",
)

# Prompt sent with a batch: head, one line per category, items, tail.
PROMPT_HEAD = (
    "You are analyzing user feedback for the {product} application. \n"
    "Please categorize the following {kind_words} into the most appropriate categories.\n"
    "\n"
    "Available categories for {kind}:\n"
    "{categories}\n"
    "\n"
    "Items to categorize:\n"
)
PROMPT_TAIL = (
    "\n"
    "\n"
    "Please respond with a JSON array where each object has:\n"
    '- "text": the original text\n'
    '- "category": the most appropriate category from the list above\n'
    '- "confidence": "High", "Medium", or "Low" \n'
    '- "reasoning": brief explanation (1-2 sentences)\n'
    "\n"
    "Ensure the response is valid JSON without markdown formatting."
)

BATCH_SIZE = 25
CHARS_PER_TOKEN = 4
OUTPUT_TOKENS_PER_ITEM = 50
INPUT_COST_PER_TOKEN = Decimal("0.000003")
OUTPUT_COST_PER_TOKEN = Decimal("0.000012")

RECENT_DAYS = 180
TOP_ISSUES = 100
TOP_POSTS = 50
TOP_TOPICS = 50
TOP_CATEGORIES = 5
TOPIC_CATEGORY_IDS = (5, 7)

GITHUB, REDDIT, DISCOURSE, UNKNOWN_SOURCE = "GitHub", "Reddit", "Discourse", "Unknown"
DELETED_AUTHOR = "[deleted]"
UNKNOWN_AUTHOR = "unknown"
ISSUE_BODY_COMMENT_ID = "0"
POST_URL_BASE = "https://reddit.com"

# --------------------------------------------------------------------------
# Defaults of this package (replaceable)
# --------------------------------------------------------------------------

# Lexicon of the built-in classifier: kind -> category -> single lower-case words.
LEXICON = {
    PAIN_POINTS: {
        "Sync & Data Management": ("sync", "syncing", "synchronisation", "conflict", "webdav", "cloud"),
        "Editor & Text Input": ("editor", "typing", "cursor", "paste", "keyboard", "undo"),
        "Mobile Experience": ("mobile", "android", "ios", "iphone", "tablet", "phone"),
        "Performance & Speed": ("slow", "lag", "freeze", "hang", "memory", "cpu"),
        "UI/UX & Interface": ("ui", "interface", "clunky", "dated", "layout", "window"),
        "Import/Export & Migration": ("import", "export", "migrate", "migration", "convert", "enex"),
        "Search & Organization": ("search", "tag", "tags", "notebook", "folder", "sort"),
        "Plugin & Extension Issues": ("plugin", "plugins", "extension", "addon", "clipper", "api"),
        "Installation & Setup": ("install", "installation", "setup", "update", "upgrade", "installer"),
        "Markdown & Formatting": ("markdown", "formatting", "table", "render", "katex", "mermaid"),
        "File Handling": ("file", "files", "attachment", "attachments", "pdf", "image"),
        "Backup & Recovery": ("backup", "restore", "recovery", "lost", "deleted", "history"),
        "Cross-Platform Compatibility": ("linux", "windows", "macos", "wayland", "platform", "desktop"),
        "Security & Privacy": ("encryption", "password", "privacy", "security", "e2ee", "lock"),
    },
    FEATURE_REQUESTS: {
        "Editor Enhancements": ("editor", "typing", "cursor", "paste", "vim", "spellcheck"),
        "Mobile Features": ("mobile", "android", "ios", "widget", "tablet", "phone"),
        "Sync Improvements": ("sync", "syncing", "webdav", "cloud", "conflict", "server"),
        "UI/UX Enhancements": ("ui", "interface", "layout", "theme", "window", "icons"),
        "Search & Filter Features": ("search", "filter", "find", "query", "regex", "fuzzy"),
        "Organization & Tagging": ("tag", "tags", "notebook", "folder", "sort", "pin"),
        "Import/Export Features": ("import", "export", "pdf", "convert", "html", "docx"),
        "Plugin & Integration": ("plugin", "plugins", "integration", "api", "clipper", "calendar"),
        "Performance Optimizations": ("faster", "speed", "performance", "memory", "startup", "lazy"),
        "Security Features": ("encryption", "password", "privacy", "lock", "biometric", "security"),
        "Collaboration Features": ("share", "sharing", "collaborate", "collaboration", "team", "publish"),
        "Customization Options": ("custom", "customize", "css", "shortcut", "font", "settings"),
        "Automation & Workflow": ("automation", "template", "templates", "workflow", "reminder", "schedule"),
        "Markdown Extensions": ("markdown", "katex", "mermaid", "diagram", "footnote", "table"),
    },
}

# Words the built-in thread extractor looks for.
PAIN_CUES = ("bug", "broken", "crash", "error", "fails", "lost", "problem", "slow", "wrong")
REQUEST_CUES = ("add", "feature", "option", "please", "request", "should", "suggest", "support", "wish")
POSITIVE_CUES = ("good", "great", "love", "nice", "thanks")
NEGATIVE_CUES = ("awful", "bad", "broken", "frustrating", "hate", "lost", "terrible")
HIGH_PRIORITY_CUES = ("crash", "lost", "corrupt", "unusable", "urgent")
MEDIUM_PRIORITY_CUES = ("bug", "broken", "error", "fails", "slow", "wrong")
DEVELOPER_CUES = ("api", "code", "developer", "git", "plugin", "script")
