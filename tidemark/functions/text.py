"""Text rules: sensitivity, redaction, titles, tokens, lexical forms. Native expressions; Unicode folding by a map built by rule."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sites import _col, blocked_site, valid_site

# Substrings that mark a text as sensitive.
SENSITIVE = (
    "porn", "sex", "suicide", "diagnos", "cancer", "oncolog", "patient", "medical record", "bank account", "inbox", "password",
    "passwort", "wachtwoord", "mot de passe", "religio", "politic", "politiek", "politisch", "election", "verkiezing", "wahlkampf",
    "depress", "hiv", "pregnan", "schwanger", "zwanger", "geestelijke", "santé", "病", "政治", "宗教", "健康", "診断",
)
# Titles that say nothing, after normalisation.
GENERIC_TITLES = (
    "home", "home x", "x home", "x", "x twitter", "twitter x", "twitter", "twitter home", "home twitter", "explore x", "x explore",
    "for you x", "x for you", "feed x", "x feed", "explore twitter", "twitter explore", "for you twitter", "twitter for you",
    "feed twitter", "twitter feed", "youtube", "youtube com", "youtube home", "home youtube", "google", "google search", "new tab",
    "new tab page", "start page", "reddit", "reddit home", "home reddit", "feed reddit", "reddit feed", "instagram", "instagram home",
    "facebook", "facebook home", "tiktok", "tiktok home", "linkedin", "linkedin home", "home linkedin", "linkedin feed",
    "feed linkedin", "explore", "for you", "feed", "weather", "calendar", "blank",
)
# Words of questions that do not discriminate, in five languages.
STOPWORDS = (
    "is", "it", "to", "be", "of", "in", "on", "at", "as", "by", "or", "my", "we", "an", "do", "so", "if", "de", "la", "el", "en", "es",
    "un", "le", "du", "au", "je", "il", "et", "ik", "op", "te", "im", "am", "zu", "um", "what", "about", "the", "and", "with", "that",
    "this", "does", "have", "for", "are", "was", "can", "how", "why", "which", "when", "where", "who", "you", "your", "our", "its",
    "has", "had", "did", "could", "would", "should", "from", "into", "than", "then", "not", "but", "without", "best", "topic", "intent",
    "constraint", "recall", "research", "researched", "look", "looked", "looking", "read", "open", "opened", "visit", "visited", "saw",
    "page", "pages", "site", "sites", "called", "compare", "comparing", "exact", "another", "session", "sessions", "der", "die", "das",
    "ein", "eine", "einer", "eines", "für", "dem", "den", "mit", "von", "zum", "zur", "auf", "aus", "als", "welche", "welcher",
    "welches", "wie", "hatte", "ich", "mein", "meine", "voor", "het", "een", "dat", "wat", "welk", "mijn", "met", "van", "naar",
    "welke", "pour", "les", "des", "une", "que", "quel", "quelle", "quelles", "quels", "dans", "avec", "sans", "sur", "mon", "mes",
    "aux", "est", "ces", "cette", "comment", "avais", "qué", "sobre", "investigué", "investigue", "consulté", "leí", "abrí", "página",
)
# Redaction patterns in their order (classes of all scripts), and what stands in their place.
REDACTIONS = (
    # from the begin of a run, or where the last match ended: no other place of it can match, and long runs are read once
    (r"(?iU)(?:\G|(?<![\w.+-]))[\w.+-]++@[\w.-]+\.[a-z]{2,}", "[redacted email]"),
    (r"(?iU)(bearer\s+\S+|(?:token|password|session|secret|api[_ -]?key)\s*[:=]\s*\S+|\b[a-z0-9_-]{40,}\b)", "[redacted]"),
    (r"(?U)\+?\d[\d ()-]{8,}\d", "[redacted number]"),
)
ALIASES = {"airplane": "plane", "aircraft": "plane", "video": "youtube"}
CJK = r"^[぀-ヿ㐀-䶿一-鿿豈-﫿\x{20000}-\x{3134f}]{2,}$"
WORD = r"[\p{L}\p{N}]+"


def _bases() -> tuple[str, str]:
    """Letters with marks, of every script but those that compose syllables, and their base letters, by canonical decomposition."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and all(unicodedata.combining(x) for x in parts[1:]):
            pairs.append((c, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _bases()


def _compatible() -> tuple[str, str, dict[str, str]]:
    """Compatibility characters: those that stand for one other character and these, and those that stand for several."""
    one, many = {}, {}
    for c in (chr(i) for i in range(0xA0, 0x30000) if not 0xD800 <= i < 0xE000):
        plain = unicodedata.normalize("NFKC", c)
        if plain != c:
            (one if len(plain) == 1 else many)[c] = plain
    return "".join(one), "".join(one.values()), many


WIDE_FROM, WIDE_TO, WIDE_MANY = _compatible()


def _covering(characters: str, gap: int = 256) -> str:
    """A class of few ranges that holds all the characters, and others that lie between them; below 256 only themselves."""
    codes, out = sorted(map(ord, characters)), []
    for c in codes:
        if out and c - out[-1][1] <= (1 if c < 256 else gap) and (out[-1][1] >= 256 or c < 256):
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


MAYBE_WIDE = _covering(WIDE_FROM + "".join(WIDE_MANY))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def compatible(text: Column | str) -> Column:
    """The text in compatibility form: full-width letters and digits, styled letters, ligatures and the like as the plain
    characters that they stand for. Native; marks that stand apart from their letter stay so."""
    several, values = "".join(WIDE_MANY), list(WIDE_MANY.values())
    meaning = F.map_from_arrays(F.lit(list(WIDE_MANY)), F.lit(values))
    spelt = lambda plain: F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(meaning, c), c)), "")
    # by hash of each character: a class of so many characters is tried one by one
    exact = lambda plain: F.when(F.translate(plain, several, "") != plain, spelt(plain)).otherwise(plain)
    return once(_col(text), lambda c: F.when((F.octet_length(c) > F.char_length(c)) & c.rlike(MAYBE_WIDE), once(F.translate(c, WIDE_FROM, WIDE_TO), exact)).otherwise(c))


def fold(text: Column | str) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.regexp_replace(F.lower(_col(text)), r"[\x{300}-\x{36f}]", ""), FOLD_FROM, FOLD_TO)


def tokens(text: Column | str) -> Column:
    """Runs of letters and digits of the folded text, in order."""
    return F.regexp_extract_all(fold(F.coalesce(_col(text), F.lit(""))), F.lit(f"({WORD})"))


#: The stop words as tokens are.
STOP_FOLDED = sorted({"".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)) for w in STOPWORDS})


def query_terms(text: Column | str, most: int = 32) -> Column:
    """Distinct tokens in order of first use, without stop words and single letters, at most ``most``."""
    stop = F.array(*[F.lit(w) for w in STOP_FOLDED])
    useful = F.filter(tokens(text), lambda t: ((F.length(t) >= 2) | t.rlike(r"^\d+$")) & ~F.array_contains(stop, t))
    return F.slice(F.array_distinct(useful), 1, most)


def inflections(term: Column) -> Column:
    cut = F.when(term.rlike(r"^\p{L}+$") & term.endswith("s") & (F.length(term) >= 5), F.substring(term, F.lit(1), F.length(term) - 1))
    return F.array_compact(F.array(term, cut))


def lexical_forms(term: Column) -> Column:
    """A term, its light singular, and its alias."""
    alias = F.coalesce(*[F.when(term == k, F.lit(v)) for k, v in ALIASES.items()])
    return F.array_compact(F.concat(inflections(term), F.array(alias)))


def held_forms(content: Column | str) -> Column:
    """The forms under which a text's tokens are found."""
    return F.array_distinct(F.flatten(F.transform(_col(content), inflections)))


def coverage(terms: Column, content: Column, held: Column | None = None) -> Column:
    """struct(matched, coverage): terms of the question that the evidence has in some form; CJK phrases also inside a token.
    ``held``: the content's ``held_forms``, where they are at hand."""
    held = F.flatten(F.transform(content, inflections)) if held is None else held
    hit = F.filter(terms, lambda t: F.arrays_overlap(lexical_forms(t), held) | (t.rlike(CJK) & F.exists(content, lambda c: F.contains(c, t))))
    return F.struct(F.size(hit).alias("matched"), F.when(F.size(terms) > 0, F.size(hit) / F.size(terms)).otherwise(F.lit(0.0)).alias("coverage"))


def sensitive(text: Column | str) -> Column:
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    return low.rlike("|".join(SENSITIVE))


def redact(text: Column | str, most: int | None = None) -> Column:
    """Compatibility form, control characters out, e-mails, secrets and phone numbers replaced in that order, cut, trimmed."""
    out = F.regexp_replace(compatible(text), r"[\x00-\x1f\x7f-\x{9f}]", "")
    for pattern, stand_in in REDACTIONS:
        out = F.regexp_replace(out, pattern, stand_in)
    return F.trim(out if most is None else F.substring(out, 1, most))


def compact(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}]", "")


def squeeze(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def normalized_title(title: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(title)), r"[^\p{L}\p{N}]+", " "))


def generic_title(title: Column | str) -> Column:
    return normalized_title(title).isin(*GENERIC_TITLES)


def informative_title(title: Column | str) -> Column:
    name = normalized_title(title)
    return ~generic_title(title) & ~name.startswith("inbox ") & (F.length(compact(title)) >= 7)


def meaningful_search(query: Column | str) -> Column:
    query = _col(query)
    words = F.regexp_count(query, F.lit(WORD))
    return (words >= 2) | (query.rlike(r"[^\x00-\x7f]") & (F.length(compact(query)) >= 5))


def prominent(title: Column | str, query: Column | str, secs: Column | str, sessions: Column | str, confirmed: Column | str) -> Column:
    query, secs, sessions = _col(query), _col(secs), _col(sessions)
    asked = F.coalesce(F.trim(query) != "", F.lit(False))
    return _col(confirmed) | F.when(asked, meaningful_search(query) & ((secs >= 10) | (sessions >= 2))).otherwise(informative_title(title) & (sessions >= 2))


def groupable(title: Column | str, query: Column | str) -> Column:
    return F.coalesce(meaningful_search(query), F.lit(False)) | informative_title(title)


# Search pages by host, path and parameter.
GOOGLE = ("google.com", "google.co.uk", "google.de", "google.nl", "google.fr", "google.co.jp", "google.ca", "google.com.au")
AMAZON = ("amazon.com", "amazon.co.uk", "amazon.de", "amazon.nl", "amazon.fr", "amazon.co.jp", "amazon.ca", "amazon.com.au", "amazon.it", "amazon.es")
SEARCH_PAGES = ((GOOGLE, ("/search",), "q"), (("bing.com",), ("/search",), "q"), (("duckduckgo.com", "search.brave.com", "kagi.com"), ("/", "/search"), "q"), (AMAZON, ("/s",), "k"), (("youtube.com",), ("/results",), "search_query"))
PRIVATE_PATH = r"(?i)(^|/)(login|signin|sign-in|auth|account|checkout|patient|inbox|messages)(/|$)"


def url_parts(url: Column | str) -> tuple[Column, Column, Column]:
    """Host (lower case), path ('/' if none) and raw query string of an http(s) address; null host otherwise."""
    url = _col(url)
    host = F.regexp_extract(url, r"^(?i:https?)://([^/?#@:]+)(?::\d+)?(?:[/?#]|$)", 1)
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.when(host != "", F.lower(host)), F.when(path == "", F.lit("/")).otherwise(path), query


def search_term(url: Column | str) -> Column:
    """The search words in the address of a known search page, if there is exactly one such parameter; else null."""
    host, path, query = url_parts(url)
    bare = F.regexp_replace(host, r"^www\.", "")
    param = F.coalesce(*[F.when(bare.isin(*hosts) & path.isin(*paths), F.lit(p)) for hosts, paths, p in SEARCH_PAGES])
    values = F.filter(F.split(query, "&"), lambda kv: F.split_part(kv, F.lit("="), F.lit(1)) == param)
    value = F.try_url_decode(F.regexp_replace(F.element_at(values, 1), r"^[^=]*=?", ""))
    return F.when(F.size(values) == 1, F.nullif(redact(value, 512), F.lit("")))


def sanitized(url: Column | str, title: Column | str, allowed: Column, private: Column | None = None) -> Column:
    """struct(site, title, query, kind) of a tab, null where nothing may be kept of it: no http(s) address, credentials in
    it, a site that is not valid or is blocked or not ``allowed``, a private path, a sensitive title or search, more than
    2048 bytes of them, or a ``private`` window."""
    url = _col(url)
    site, path, _ = url_parts(url)
    clean, asked = redact(F.coalesce(_col(title), F.lit("")), 256), search_term(url)
    credentials = F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1).contains("@")
    refused = credentials | ~valid_site(site) | blocked_site(site) | path.rlike(PRIVATE_PATH) | ~allowed | sensitive(clean) | F.coalesce(sensitive(asked), F.lit(False))
    refused = refused | (F.octet_length(F.concat(clean, F.coalesce(asked, F.lit("")))) > 2048) | F.coalesce(F.lit(False) if private is None else private, F.lit(False))
    kept = F.struct(site.alias("site"), clean.alias("title"), asked.alias("query"), F.when(asked.isNotNull(), F.lit("search")).otherwise(F.lit("visit")).alias("kind"))
    return F.when(site.isNotNull() & ~refused, kept)
