"""Fixed values of the ticket domain.

Everything here has to have exactly these values for results to be right:
category names and their order, keyword lists and their order, limits, the
memo lifetime, and the texts a prompt is put together from.
"""

# --- fixed values: categories, in tie-break order -------------------------
CATEGORIES = [
    "Product Issue",
    "Software Issue",
    "Network Issue",
    "Battery Issue",
    "General Question",
]
DEFAULT_CATEGORY = "General Question"

# --- fixed values: keyword lists, in order --------------------------------
KEYWORDS = {
    "Product Issue": ["broken", "cracked", "damaged", "defective", "screen", "hardware", "physical", "button"],
    "Software Issue": ["crash", "bug", "error", "install", "update", "app", "software", "freeze", "slow"],
    "Network Issue": ["wifi", "internet", "connection", "network", "vpn", "connect", "online", "bluetooth"],
    "Battery Issue": ["battery", "charging", "charge", "drain", "power", "dies", "percentage"],
    "General Question": ["how to", "how do", "what is", "password", "account", "help", "reset", "where"],
}
KEYWORD_REASONING = "Classified using keyword matching (fallback mode)"
MAX_INDICATORS = 3

# --- fixed values: statuses -----------------------------------------------
STATUS_OPEN = "open"
STATUS_CLASSIFIED = "classified"
STATUS_CORRECTED = "corrected"
STATUS_RESOLVED = "resolved"

# --- fixed values: limits --------------------------------------------------
TITLE_MAX = 255
DESCRIPTION_MIN = 10
DESCRIPTION_MAX = 5000
FEEDBACK_MAX = 1000
DEFAULT_TITLE_CHARS = 100
CONTEXT_CHARS = 80
PAGE_LIMIT_MAX = 100
PAGE_LIMIT_DEFAULT = 20
RECENT_LIMIT = 5

# --- fixed values: memo ----------------------------------------------------
MEMO_PREFIX = "classify:"
MEMO_HEX_CHARS = 32
MEMO_TTL_SECONDS = 7 * 24 * 60 * 60

# --- fixed values: neighbours and answers ----------------------------------
CONTEXT_NEIGHBOURS = 3
SEARCH_NEIGHBOURS = 5
EXAMPLES_PER_CATEGORY = 3
ANSWER_DEFAULT_CONFIDENCE = 0.5
UNKNOWN_CATEGORY = "unknown"

# --- fixed values: prompt texts --------------------------------------------
NO_NEIGHBOURS_TEXT = "No similar tickets found."
NO_TITLE_TEXT = "No title provided"
CATEGORY_DEFINITIONS = """
- **Product Issue**: Physical hardware problems - cracked screens, broken buttons, damaged devices, defective parts, manufacturing issues
- **Software Issue**: Application problems - crashes, bugs, errors, failed installations, update issues, freezing, performance problems
- **Network Issue**: Connectivity problems - WiFi not working, internet outages, VPN failures, slow connections, Bluetooth issues
- **Battery Issue**: Power problems - fast draining, won't charge, overheating while charging, battery percentage issues, power-off problems  
- **General Question**: Information requests - how-to questions, account help, password resets, feature inquiries, general support
"""
PROMPT_HEAD = """You are an expert support ticket classifier for a technology company.

## Your Task
Classify the support ticket below into exactly ONE category.

## Categories
"""
PROMPT_NEIGHBOURS = """

## Similar Past Tickets (for context)
"""
PROMPT_TITLE = """

## Ticket to Classify
**Title:** """
PROMPT_DESCRIPTION = """
**Description:** """
PROMPT_TAIL = """

## Instructions
1. Analyze the ticket content carefully
2. Consider the similar past tickets for context
3. Choose the single most appropriate category
4. Provide confidence based on clarity (0.9+ for obvious, 0.7-0.9 for clear, 0.5-0.7 for ambiguous)

## Required Output Format (JSON only, no markdown)
{"category": "<category name>", "confidence": <0.0-1.0>, "reasoning": "<explanation>", "key_indicators": ["<phrase1>", "<phrase2>"]}"""
