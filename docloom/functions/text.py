"""Rule-based text expressions: query analysis, names, paths, scrubbing.

Everything is a ``Column``; word borders are spelled out as explicit classes, so the
rules read the same in any regex engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases and cue words of the rules, in the order in which they apply.
SMALLTALK = [
    "hi", "hello", "hey", "howdy", "hola", "greetings", "yo", "sup", "good morning", "good afternoon", "good evening", "good day",
    "how are you", "hows it going", "how do you do", "whats up", "thanks", "thank you", "thank you so much", "thx", "ty", "cheers",
    "bye", "goodbye", "see you", "take care", "later", "cya", "have a good day", "have a nice day", "ok", "okay", "alright", "sure",
    "got it", "understood", "cool", "nice", "great", "awesome", "who are you", "what are you", "what can you do", "what do you do", "help",
]
GENERATIVE = ["create", "generate", "make", "build"]
PROCEDURAL = ["how to", "steps", "process", "procedure"]
ANALYTICAL = ["compare", "analyze", "trend", "summary"]
#: Words that name a department in a question.
DEPARTMENTS = {
    "hr": ["hr", "leave", "policy", "onboarding", "benefit", "salary"],
    "finance": ["budget", "revenue", "financial", "expense", "forecast"],
    "sales": ["pipeline", "deal", "quota", "client", "prospect"],
    "marketing": ["campaign", "brand", "content", "social", "launch"],
}
#: Names of departments for filters, as patterns between word borders.
FILTER_DEPARTMENTS = {
    "hr": ["hr", "human\\s+resources?", "people\\s+ops?"],
    "finance": ["finance", "financial", "accounting", "budget"],
    "sales": ["sales", "revenue", "pipeline", "deals?"],
    "marketing": ["marketing", "campaign", "brand"],
}
PATH_DEPARTMENTS = {
    "hr": ["hr", "human resources", "people", "talent"],
    "finance": ["finance", "accounting", "budget", "fiscal"],
    "sales": ["sales", "revenue", "deals", "pipeline"],
    "marketing": ["marketing", "brand", "campaign", "comms"],
}
#: Cue words that are counted per department.
SCORED_DEPARTMENTS = {
    "hr": [
        "pto", "leave", "vacation", "holiday", "parental", "sick", "benefits", "onboarding", "offboarding", "payroll", "salary",
        "compensation", "performance review", "fmla", "ada", "policy", "job description", "headcount", "hire", "termination",
    ],
    "finance": [
        "budget", "revenue", "p&l", "profit", "loss", "ebitda", "cash flow", "invoice", "expense", "reimbursement", "vendor", "procurement",
        "forecast", "quarter", "fiscal", "audit", "tax", "balance sheet", "accounts", "capex", "opex", "kpi", "variance",
    ],
    "sales": [
        "pipeline", "deal", "opportunity", "quota", "crm", "salesforce", "close", "prospect", "account", "contract", "negotiation", "arr",
        "mrr", "churn", "win rate", "lead", "territory", "commission",
    ],
    "marketing": [
        "campaign", "content", "brand", "social", "email", "seo", "ads", "attribution", "roi", "conversion", "funnel", "engagement",
        "impressions", "ctr", "cpl", "event", "webinar", "press release",
    ],
}
DOC_TYPES = {"pptx": ["pptx", "presentation", "slide"], "xlsx": ["xlsx", "spreadsheet"], "docx": ["docx", "document", "report"]}
CONTENT_TYPES = {
    "policy": ["policy", "procedure", "guideline"],
    "report": ["report"],
    "presentation": ["presentation", "deck", "slides"],
    "spreadsheet": ["spreadsheet"],
    "memo": ["memo"],
    "announcement": ["announcement"],
}
COMPLEX = ["compare", "contrast", "analyze", "analysis", "across", "trend", "throughout", "synthesize", "generate", "create", "draft", "write", "build"]
HOW_TO = ["how to", "how do i", "steps to", "guide", "tutorial", "procedure"]
COMPARE = ["compare", "difference", "vs", "versus", "pros and cons", "trade-off"]
STRATEGY = {"analytical": "hyde_cosine", "procedural": "mmr"}
#: The router's strategies by kind of question.
ROUTED = {"analytical": "hyde_cosine", "generative": "hyde_cosine", "procedural": "mmr"}
KNOWN_DEPARTMENTS = ["hr", "finance", "sales", "marketing", "general"]


#: A token: a run of letters and digits, or a single other ASCII sign.
TOKEN = "[A-Za-z0-9_\\x{80}-\\x{10FFFF}]+|[!-/:-@\\[-^`{-~]"


def has_any(text: Column, phrases: list[str]) -> Column:
    """True if a phrase occurs anywhere in lower-cased text."""
    out = F.lit(False)
    for p in phrases:
        out |= text.contains(p)
    return out


def has_word(text: Column, options: list[str]) -> Column:
    """True if one of ``options`` stands between non-word characters."""
    return text.rlike("(^|[^a-z0-9_])(" + "|".join(options) + ")([^a-z0-9_]|$)")


def first_of(rules: dict[str, Column], default: Column | None = None) -> Column:
    """The first name whose condition holds."""
    out = None
    for name, test in rules.items():
        out = F.when(test, name) if out is None else out.when(test, name)
    return out if default is None else out.otherwise(default)


def smalltalk(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(text)), "[!?.,:; ]+$", "")
    return bare.isin(SMALLTALK)


def query_type(text: Column) -> Column:
    """smalltalk, generative, procedural, analytical or factual, in that order."""
    low = F.lower(text)
    return first_of({"smalltalk": smalltalk(text), "generative": has_any(low, GENERATIVE), "procedural": has_any(low, PROCEDURAL), "analytical": has_any(low, ANALYTICAL)}, F.lit("factual"))


def department(text: Column) -> Column:
    """First department with one of its words in the text, else null."""
    return first_of({d: has_word(F.lower(text), w) for d, w in DEPARTMENTS.items()})


def department_by_score(text: Column) -> Column:
    """Department with the most of its cue words anywhere in the text, at least two;
    ties to the first."""
    low = F.lower(text)
    score = {d: sum((low.contains(w).cast("int") for w in words), F.lit(0)) for d, words in SCORED_DEPARTMENTS.items()}
    most = F.greatest(*score.values())
    return first_of({d: (most >= 2) & (s == most) for d, s in score.items()})


def named_department(text: Column) -> Column:
    """First department whose name stands in the text, else null."""
    return first_of({d: has_word(F.lower(text), w) for d, w in FILTER_DEPARTMENTS.items()})


def department_from_path(path: Column, inside_words: bool = False) -> Column:
    """First department with one of its words in a path; words stand between borders, so
    that "hr" is no part of another word, unless ``inside_words``."""
    test = has_any if inside_words else has_word
    return first_of({d: test(F.lower(path), w) for d, w in PATH_DEPARTMENTS.items()})


def normal_department(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.when(low.isin(KNOWN_DEPARTMENTS), low).otherwise("general")


def strategy(kind: Column) -> Column:
    return first_of({s: kind == k for k, s in STRATEGY.items()}, F.lit("cosine"))


def routed_strategy(text: Column, given: Column, kind: Column | None = None) -> Column:
    """The router's strategy: none for smalltalk; where none or cosine is given, by kind
    (by default the rules' own), how-to words override it and words of comparison both."""
    low, kind = F.lower(text), query_type(text) if kind is None else kind
    free = given.isNull() | (given == "cosine")
    own = F.when(has_any(low, COMPARE), "hyde_cosine").when(has_any(low, HOW_TO), "mmr").otherwise(first_of({s: kind == k for k, s in ROUTED.items() if s == "mmr"}, F.when(kind.isin("analytical", "generative"), "hyde_cosine").otherwise("cosine")))
    return F.when(kind == "smalltalk", "none").when(free, own).otherwise(given)


def document_type(text: Column) -> Column:
    low = F.lower(text)
    return F.when(has_any(low, GENERATIVE), first_of({t: has_any(low, w) for t, w in DOC_TYPES.items()}))


def content_type(text: Column) -> Column:
    return first_of({t: has_any(F.lower(text), w) for t, w in CONTENT_TYPES.items()})


def is_complex(text: Column) -> Column:
    """A cue word, or more than 15 words."""
    return has_any(F.lower(text), COMPLEX) | (F.size(F.filter(F.split(text, "[ \\t\\n]+"), lambda w: w != "")) > 15)


def file_extension(name: Column) -> Column:
    """Text after the last dot, lower-cased; empty if there is no dot."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def scrub(text: Column) -> Column:
    """E-mail addresses, social security numbers and phone numbers become tags."""
    out = F.regexp_replace(text, "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b", "[EMAIL]")
    out = F.regexp_replace(out, "\\b[0-9]{3}[-.\\s]?[0-9]{2}[-.\\s]?[0-9]{4}\\b", "[SSN]")
    return F.regexp_replace(out, "\\b(\\+1[-.\\s]?)?\\(?[0-9]{3}\\)?[-.\\s]?[0-9]{3}[-.\\s]?[0-9]{4}\\b", "[PHONE]")


def token_count(text: Column) -> Column:
    """Runs of ASCII letters and digits, and single other ASCII signs."""
    return F.regexp_count(text, F.lit(TOKEN))


def truncate_tokens(text: Column, most: int = 8000) -> Column:
    """A text of more than ``most`` tokens cut after that many, by the token array."""
    tokens = F.regexp_extract_all(text, F.lit(f"(?:{TOKEN})[ \\t\\n\\r]*"), F.lit(0))
    return F.when(F.size(tokens) <= most, text).otherwise(F.regexp_replace(F.array_join(F.slice(tokens, 1, most), ""), "[ \\t\\n\\r]+$", ""))


def path_ids(path: Column) -> list[Column]:
    """``drive_id`` and ``item_id`` of a file that has none: slices of its path's digest,
    the same whenever it is read."""
    digest = F.md5(path)
    return [F.concat(F.lit("local-drive-"), F.substring(digest, 1, 12)).alias("drive_id"), F.concat(F.lit("local-item-"), F.substring(digest, 13, 12)).alias("item_id")]


def notification_drive(resource: Column) -> Column:
    """Drive of a notification's resource ``drives/ID/...``; null for others."""
    parts = F.split(resource, "/")
    return F.when((F.get(parts, F.lit(0)) == "drives") & (F.size(parts) >= 2), F.get(parts, F.lit(1)))


def notification_verified(state: Column, secret: str | None) -> Column:
    """Whether the third part of ``site:drive:secret`` is the secret; all are where none is set."""
    if not secret:
        return F.lit(True)
    return F.coalesce(F.get(F.split(state, ":"), F.lit(2)) == secret, F.lit(False))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != ""))


def entity_name(name: Column) -> Column:
    """Trimmed, inner space collapsed; null unless 2 to 100 characters long."""
    out = F.trim(F.regexp_replace(name, "[ \\t\\n\\r]+", " "))
    return F.when(F.length(out).between(2, 100), out)


def fenced_json(text: Column) -> Column:
    """Text without a Markdown code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "^\\s*```[a-z]*\\s*", ""), "\\s*```\\s*$", ""))


def doc_spec(text: Column, schema: str) -> Column:
    """The JSON between ``<doc_spec>`` marks, parsed; null if absent or malformed."""
    body = F.regexp_extract(text, "(?s)<doc_spec>(.*?)</doc_spec>", 1)
    return F.when(body != "", F.from_json(fenced_json(body), schema, {"mode": "PERMISSIVE"}))


def filter_department(analysis: Column, question: Column, user: Column) -> Column:
    """Department of a filter: analysis, then a name in the question, then the user's."""
    return F.coalesce(analysis, named_department(question), user)


def last_folder(path: Column) -> Column:
    """Last folder of the part of a path after the colon."""
    tail = F.when(path.contains(":"), F.substring_index(path, ":", -1)).otherwise(path)
    return F.try_element_at(F.filter(F.split(tail, "/"), lambda x: x != ""), F.lit(-1))


def edge_weight(kind: Column, count: Column, strength: Column) -> Column:
    """Traversal weight of a relation (fixed values)."""
    return (
        F.when(kind == "SUPERSEDES", 0.95)
        .when(kind == "CITES", 0.9)
        .when(kind == "SHARES_ENTITY", 0.5 + 0.05 * count)
        .when(kind == "RELATED_TO", F.coalesce(strength, F.lit(0.5)))
        .otherwise(0.3)
    )


def date_range(text: Column, as_of: Column) -> tuple[Column, Column]:
    """(from, to) of a relative expression, half-open; nulls if there is none.

    last N day(s), this/last week, this/last month, this/last quarter, this/last year,
    in Qn YYYY, since YYYY, in YYYY; the first that matches wins.
    """
    low = F.lower(text)
    said = lambda pattern, group=0: F.regexp_extract(low, f"(?:^|[^a-z0-9_]){pattern}(?:[^a-z0-9_]|$)", group)
    days = said("last\\s+([0-9]+)\\s+days?", 1)
    q, qy = (said("in\\s+q([1-4])\\s+([0-9]{4})", k) for k in (1, 2))
    since, year = said("since\\s+([0-9]{4})", 1), said("in\\s+([0-9]{4})", 1)
    number = lambda c: F.try_to_number(c, F.lit("9999")).cast("int")
    rules: list[tuple[Column, Column, Column]] = [(days != "", as_of - F.make_interval(days=number(days)), as_of)]
    for unit, months in (("week", None), ("month", 1), ("quarter", 3), ("year", 12)):
        start = F.date_trunc(unit, as_of)
        back = start - F.make_interval(days=F.lit(7)) if months is None else F.date_trunc(unit, F.add_months(start, -months))
        rules += [(said(f"this\\s+{unit}") != "", start, as_of), (said(f"last\\s+{unit}") != "", back, start)]
    start = F.make_timestamp(number(qy), number(q) * 3 - 2, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    rules.append((q != "", start, F.date_trunc("day", F.add_months(start, 3))))
    rules.append((since != "", F.make_timestamp(number(since), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), as_of))
    rules.append((year != "", F.make_timestamp(number(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp(number(year) + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))))
    a = b = None
    for test, x, y in rules:
        a = F.when(test, x) if a is None else a.when(test, x)
        b = F.when(test, y) if b is None else b.when(test, y)
    return a.cast("timestamp"), b.cast("timestamp")
