"""Fixed values the results depend on.

Fixed values (must not change; they define the label space and the
text formats that downstream parsing and evaluation rely on):

- classes, in this order (the order is the label id and the parser's
  precedence): valid, advertisement, irrelevant, rants without visit
- binary view: valid, invalid
- error prefix of a failed prediction: "ERROR:"
- default cleaning pattern: "ERROR: Error calling OpenAI API: Err"
- profile error patterns: "ERROR:", "Error calling", "Rate limit", "API Error"
- empty markers (after strip, any case): "", "null", "none", "nan"
- placeholder business name: "Unknown Business"
- empty embedding text replacement: "No content"
- no retrieved examples: "No similar examples found."
- unknown category: "Unknown"
- model call settings: max_tokens 1024 (2048 for the cot_rag template),
  temperature 0.1
"""

CLASSES = ["valid", "advertisement", "irrelevant", "rants without visit"]
BINARY_CLASSES = ["valid", "invalid"]
ERROR_PREFIX = "ERROR:"
DEFAULT_CLEAN_PATTERN = "ERROR: Error calling OpenAI API: Err"
PROFILE_ERROR_PATTERNS = ["ERROR:", "Error calling", "Rate limit", "API Error"]
EMPTY_MARKERS = ["", "null", "none", "nan"]
UNKNOWN_BUSINESS = "Unknown Business"
NO_CONTENT = "No content"
NO_EXAMPLES = "No similar examples found."
UNKNOWN_CATEGORY = "Unknown"
OTHER_LABEL = "__other__"

# Python's str.strip()/str.isspace() white space, as a Java regex class
# (used with the (?U) flag so \s is Unicode White_Space; Python also
# counts the four information separators U+001C..U+001F as space).
PY_WS = r"[\s\x{1c}-\x{1f}]"

MAX_TOKENS = 1024
MAX_TOKENS_RAG = 2048
TEMPERATURE = 0.1
