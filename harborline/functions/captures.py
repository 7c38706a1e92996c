"""Whether a captured page holds a posting."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions.text import collapse, has_phrase, let, plain_words

# Fixed phrases, in lower case, of pages that are no postings, in the order in which they decide.
ISSUES = {
    "unrendered": ("skip to content loading", "skip to main content loading", "resource you have requested is not available", "la ressource que vous avez demandée n'est pas disponible"),
    "error_page": ("nosuchkey", "specified key does not exist"),
    "bot_challenge": (
        "checking your browser", "confirm you are not a robot", "please verify you are human", "activity and behavior on site made us think that you are a bot",
        "activity and behavior on this site made us think that you are a bot", "activity and behavior on this website made us think that you are a bot",
    ),
    "expired_page": (
        "this position is no longer available", "this job is no longer available", "this posting is no longer available", "sorry, posting is no longer available",
        "this job has expired", "this job has already expired", "this job posting has already expired",
    ),
}
STARTS = ("loading... skip to content", "loading... skip to main content")
NOT_FOUND = r"(?m)^\s*404 not found\b"
INCIDENT = r"incident id:\s*[a-f0-9-]{8,}"
# Fixed phrases of sources whose portals answer in place of a posting: all of the first, one of the second, none of the third.
PORTALS = {
    "Government of Canada": (
        ("join our talent community", "current openings", "1 of 1"), (),
        ("job requisition id", "posted on", "salary range", "employment tenure", "who can apply", "position summary", "duties", "qualifications", "responsibilities"),
    ),
    "ICBC": ((), ("talent community", "talent pool"), ("position highlights", "position requirements")),
    "SaskTel": ((), (), ("job description", "position summary", "salary", "location", "closing date", "apply by", "department", "employment type")),
}


def _holds(text: Column, phrases) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def _portal(text: Column, source: Column) -> Column:
    words, hit = plain_words(text), F.lit(False)
    for name, (every, some, none) in PORTALS.items():
        fits = ~has_phrase(words, none)
        for p in every:
            fits = fits & has_phrase(words, (p,))
        hit = hit | ((source == name) & (fits & has_phrase(words, some) if some else fits))
    return F.coalesce(hit, F.lit(False))


def capture_issue(text: Column, source: Column | None = None) -> Column:
    """Why a capture is no posting (empty, unrendered, error_page, bot_challenge, expired_page and, where the
    ``source`` is known, generic_portal), or null."""

    def issue(t: Column) -> Column:
        low = collapse(F.lower(t))
        of = {name: _holds(low, phrases) for name, phrases in ISSUES.items()}
        early = F.exists(F.array(*map(F.lit, STARTS)), lambda p: F.startswith(low, p))
        of["unrendered"] = of["unrendered"] | early | (F.contains(low, F.lit("skip to main content")) & (F.length(t) < 400))
        of["error_page"] = of["error_page"] | F.lower(t).rlike(NOT_FOUND)
        of["bot_challenge"] = of["bot_challenge"] | low.rlike(INCIDENT)
        if source is not None:
            of["generic_portal"] = _portal(t, source)
        return F.coalesce(F.when(t == "", "empty"), *(F.when(hit, name) for name, hit in of.items()))

    return let(F.trim(F.coalesce(text, F.lit(""))), issue)
