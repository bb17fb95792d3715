"""Fixed values that must equal the behaviour being reproduced.

Regular expressions are written once here and used by both the Spark
expressions and the DuckDB oracle.  Python's ``re`` classes are Unicode
(``\\w``, ``\\d``, ``\\s``, ``\\b``), Java's and RE2's are ASCII, so each class
is spelled out with Unicode properties that Java and RE2 both understand.
"""

# --- character classes (Python re semantics, spelled portably) ----------
WORD = r"[\p{L}\p{N}_]"          # Python \w: alphanumeric or underscore
NOT_WORD = r"[^\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"                # Python \d: decimal digits
# Python str.isspace(): ASCII controls 9-13 and 28-31, U+0085, Unicode Z*
SPACE = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
# the same characters, listed
SPACE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# --- fixed values: bill field patterns, in the order the fields are read --
# e-mail                    [\w\.-]+@[\w\.-]+
# 10-digit phone            \b\d{10}\b
# plan line                 Airtel Black.*        (rest of the line)
# account id                \b\d{12,}\b
# dates (find all)          \d{1,2}\s\w+\s\d{4}
# statement period          \d{1,2}\s\w+\s\d{4}\s-\s\d{1,2}\s\w+\s\d{4}
# amount after rupee sign   ₹\s?([\d,]+\.\d{2})
# month of period end       -\s\d{1,2}\s(\w+)
# year at end               (\d{4})$
PLAN_PREFIX = "Airtel Black"
CURRENCY = "₹"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
          "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SPIKE_LIMIT = 15.0    # percent change above this is a spike
DROP_LIMIT = -15.0    # percent change below this is a drop
SPIKE_LABEL = "🔺 Spike"
DROP_LABEL = "🔻 Drop"
NORMAL_LABEL = "Normal"
# insight messages, in the order they are emitted
TREND_UP = "📈 Overall trend is increasing"
TREND_DOWN = "📉 Overall trend is decreasing"
SPIKE_MSG = "🔺 Spike detected: +{change}% in {month}"
DROP_MSG = "🔻 Drop detected: {change}% in {month}"
HIGHEST_MSG = "💰 Highest bill: {currency}{amount} ({month})"
LOWEST_MSG = "💸 Lowest bill: {currency}{amount} ({month})"

EMAIL = rf"[\p{{L}}\p{{N}}_.-]+@[\p{{L}}\p{{N}}_.-]+"
# Same first match for Java's backtracking engine in linear time: the
# leftmost match always starts where the character class run starts, and the
# run before '@' never gives characters back ('@' is not in the class).
EMAIL_JAVA = rf"(?<![\p{{L}}\p{{N}}_.-])[\p{{L}}\p{{N}}_.-]++@[\p{{L}}\p{{N}}_.-]+"
DATE = rf"{DIGIT}{{1,2}}{SPACE}{WORD}+{SPACE}{DIGIT}{{4}}"
PERIOD = rf"{DATE}{SPACE}-{SPACE}{DATE}"
MONTH_OF_PERIOD = rf"-{SPACE}{DIGIT}{{1,2}}{SPACE}({WORD}+)"
YEAR_AT_END = rf"({DIGIT}{{4}})$"
# Python's $ is "end, or before one final \n"; Java's $ also stops before
# \r, \u0085, \u2028, \u2029 and RE2's only at the very end
YEAR_AT_END_JAVA = rf"({DIGIT}{{4}})(?=\n?\z)"
YEAR_AT_END_RE2 = rf"({DIGIT}{{4}})\n?$"


def amount_pattern(currency: str = CURRENCY) -> str:
    return rf"{currency}{SPACE}?([\p{{Nd}},]+\.{DIGIT}{{2}})"


# Every maximal digit run with a non-word character (or the text edge) on both
# sides; the first run of length 10 is the \b\d{10}\b match, the first of
# length >= 12 the \b\d{12,}\b match.
DIGIT_RUN_JAVA = rf"(?<!{WORD}){DIGIT}++(?!{WORD})"


def bounded_digits_java(spec: str) -> str:
    """``\\b\\d{spec}\\b`` for Java: word boundaries as lookarounds."""
    return rf"(?<!{WORD}){DIGIT}{{{spec}}}(?!{WORD})"


def bounded_digits_re2(spec: str) -> str:
    """Same for RE2 (no lookaround): boundary chars captured around group 2."""
    return rf"(^|{NOT_WORD})({DIGIT}{{{spec}}})({NOT_WORD}|$)"


def plan_java(prefix: str = PLAN_PREFIX) -> str:
    # (?d): only \n ends a line, as in Python
    return "(?d)" + _quote(prefix) + ".*"


def plan_re2(prefix: str = PLAN_PREFIX) -> str:
    return _quote(prefix) + ".*"


def _quote(s: str) -> str:
    out = []
    for ch in s:
        out.append("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch)
    return "".join(out)


# --- fixed values: health alert rules (metric, comparison, limit, message) --
HEALTH_ALERTS = [
    ("heart_rate", ">", 90.0, "High average heart rate detected"),
    ("sleep_hours", "<", 5.0, "Low sleep detected"),
]
HEALTH_COLUMNS = ["date", "heart_rate", "steps", "sleep_hours", "bp_systolic"]

# --- fixed values: missing-value tokens pandas reads as NaN by default ---
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN",
                  "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
                  "None", "n/a", "nan", "null"]

# --- fixed values: prompt templates -------------------------------------
RAG_PROMPT = """
You are an intelligent assistant.

First, try to answer using the CONTEXT below.
If the context is not useful, you can answer using your own knowledge.

Context:
{context}

Question:
{query}
"""
ANALYSIS_PROMPT = "Analyze this data:\n{summary}"
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
TOP_K = 3
PAGE_SIZES = [5, 10, 20, 50]
ATTACHMENT_SUFFIXES = [".xlsx", ".xls", ".csv"]
ATTACHMENT_WORD = "attachment"
BLANK_TRANSCRIPT_MESSAGE = "❌ Could not understand audio."
NO_DATA_INSIGHT = "Not enough data for insights"
