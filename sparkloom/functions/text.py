"""Text expressions: Column in, Column out, all inside code generation or built-in functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import rules


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def trimmed(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def approx_tokens(text: Column) -> Column:
    return count(text, r"[A-Za-z0-9_]+") + count(text, r"[一-鿿]")


def estimate_tokens(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 3).cast("int")))


def html_strip(html: Column) -> Column:
    """Text without tags as it is; else scripts and styles out, tags to spaces, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"[ \t]+", " "), r"\n{3,}", "\n\n"), F.lit(" \t\n\r"))
    return F.when(html.rlike(r"<[a-zA-Z/!]"), bare).otherwise(html)


def html_boilerplate(html: Column) -> Column:
    """The block of the first article or main element, without navigation, forms and the like; else the whole page so."""
    inner = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    inner = F.when(inner == "", F.regexp_extract(html, r"(?is)<main[^>]*>(.*?)</main>", 1)).otherwise(inner)
    body = F.when(inner == "", html).otherwise(inner)
    for tag in ("nav", "aside", "footer", "form", "svg", "iframe", "noscript"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return html_strip(body)


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _luhn_digit(digits, n, i))
    return (n > 0) & (F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0)


def _luhn_digit(digits: Column, n: Column, i: Column) -> Column:
    d = digits.substr(i, F.lit(1)).cast("int")
    twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.when((n - i) % 2 == 1, twice).otherwise(d)


def pii_stages(text: Column) -> list[tuple[str, Column, Column]]:
    """(kind, what it finds in the text that the kinds before it left, the text after it)."""
    out = []
    for kind, pattern, mark in rules.PII:
        found = F.regexp_extract_all(text, F.lit(pattern), 0)
        text = F.regexp_replace(text, pattern, mark)
        out.append((kind, found, text))
    cards = F.filter(F.regexp_extract_all(text, F.lit(rules.CARD), 0), luhn_ok)
    text = F.aggregate(F.array_distinct(cards), text, lambda t, card: F.regexp_replace(t, F.concat(F.lit(r"(?<!\d)"), card, F.lit(r"(?!\d)")), F.lit(rules.CARD_TEXT)))
    out.append(("bankcard", cards, text))
    return out


def pii_redact(text: Column) -> Column:
    return pii_stages(text)[-1][2]


def pii_scan(text: Column) -> Column:
    """A struct of ``h_<kind>``, what each kind finds in the text that the kinds before it left, and ``t``, the text after all of them.

    Each stage is bound once, so that finding and replacing go over the text once for each kind. A text without the character that
    a kind needs (an at sign, a digit) is not searched for it.
    """
    none = F.array().cast("array<string>")
    some = {"email": lambda t: t.contains("@")}
    searched = lambda kind, t, found: F.when(some.get(kind, lambda t: t.rlike("[0-9]"))(t), found).otherwise(none)

    def stage(kind: str, seen: list[str], find: Callable[[Column], Column], put: Callable[[Column, Column], Column]) -> tuple[Callable[[Column], Column], ...]:
        kept = lambda s: [s[f"h_{k}"].alias(f"h_{k}") for k in seen]
        return lambda s: F.struct(*kept(s), searched(kind, s["t"], find(s["t"])).alias(f"h_{kind}"), s["t"].alias("t")), lambda s: F.struct(*kept(s), s[f"h_{kind}"].alias(f"h_{kind}"), put(s["t"], s[f"h_{kind}"]).alias("t"))

    def pattern(p: str, mark: str):
        return lambda t: F.regexp_extract_all(t, F.lit(p), 0), lambda t, found: F.when(F.size(found) > 0, F.regexp_replace(t, p, mark)).otherwise(t)

    def cards():
        number = lambda card: F.concat(F.lit(r"(?<!\d)"), card, F.lit(r"(?!\d)"))
        return lambda t: F.filter(F.regexp_extract_all(t, F.lit(rules.CARD), 0), luhn_ok), lambda t, found: F.aggregate(F.array_distinct(found), t, lambda u, card: F.regexp_replace(u, number(card), F.lit(rules.CARD_TEXT)))

    bound, seen = F.array(F.struct(text.alias("t"))), []
    for kind, (find, put) in [*((kind, pattern(p, mark)) for kind, p, mark in rules.PII), ("bankcard", cards())]:
        for step in stage(kind, list(seen), find, put):
            bound = F.transform(bound, step)
        seen.append(kind)
    return F.element_at(bound, 1)


def low_info_score(text: Column) -> Column:
    """Near 1 for what tells nothing, 0 for prose; to three digits, which is how it is compared."""
    # bound once each: what branches repeat would be evaluated again in every one
    t = F.array(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))
    counted = F.transform(t, lambda t: F.struct(t.alias("t"), (F.length(t) - F.length(F.regexp_replace(t, rules.SUBSTANTIVE, ""))).alias("solid"), F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "").alias("words")))
    ready = F.transform(counted, lambda s: F.struct(s["t"].alias("t"), s["solid"].alias("solid"), F.size(s["words"]).alias("n"), (F.size(F.array_distinct(s["words"])) / F.greatest(F.size(s["words"]), F.lit(1))).alias("unique")))

    def rule(s: Column) -> Column:
        line = reduce(lambda a, b: a | b, [s["t"].rlike("(?i)" + p) for p in rules.BOILERPLATE_LINES])
        phrase = reduce(lambda a, b: a | b, [s["t"].rlike("(?i)" + p) for p in rules.BOILERPLATE_PHRASES])
        mixed = F.round(1.0 - F.least(F.lit(1.0), (s["unique"] + s["solid"] / F.greatest(F.length(s["t"]), F.lit(1))) / 1.5), 3)
        return (
            F.when(F.length(s["t"]) < 20, 1.0).when(s["solid"] < 10, 1.0).when(line, 0.95).when(phrase, 0.9)
            .when((s["n"] >= 8) & (s["unique"] < 0.2), 0.9).otherwise(mixed)
        )

    return F.element_at(F.transform(ready, rule), 1)


def shingles(text: Column, n: int = 5, keep_spaces: bool = False) -> Column:
    """Distinct runs of ``n`` characters; a shorter text is one. White space is taken out, or only trimmed."""
    t = F.trim(text) if keep_spaces else F.regexp_replace(text, r"(?U)\s+", "")
    # one pass of a pattern: each character is taken and, by looking ahead, the run that begins there
    runs = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), 1)
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) < n, F.array(t)).otherwise(F.array_distinct(runs))


def secret_sanitize(text: Column) -> tuple[Column, Column]:
    """(text with secrets replaced, what was found, 80 characters of each at most)."""
    hits = F.array().cast("array<string>")
    for p in rules.LEAKS:
        hits = F.concat(hits, F.regexp_extract_all(text, F.lit(p), 0))
        text = F.regexp_replace(text, p, "[REDACTED]")
    return text, F.transform(hits, lambda h: F.substring(h, 1, 80))


def injection_rule(text: Column) -> Column:
    """Number of the first rule that matches, from 1; null if none does."""
    out = F.when(text.rlike("(?i)" + rules.INJECTIONS[0]), 1)
    for k, p in enumerate(rules.INJECTIONS[1:], 2):
        out = out.when(text.rlike("(?i)" + p), k)
    return out


def mask_phone(phone: Column) -> Column:
    return F.when(F.length(phone) < 7, "****").otherwise(F.concat(F.substring(phone, 1, 3), F.repeat(F.lit("*"), F.length(phone) - 7), F.right(phone, F.lit(4))))


def stable_source_id(kb: Column, key: Column) -> Column:
    return F.concat(kb, F.lit("::"), F.substring(F.sha1(key), 1, 16))


def index_tokens(text: Column) -> Column:
    """Terms of the lexical index: lower case, runs of letters and digits, every CJK character its own."""
    spaced = F.regexp_replace(F.lower(text), f"([{rules.CJK}])", " $1 ")
    return F.regexp_extract_all(spaced, F.lit(r"[\p{L}\p{N}]+"), 0)


def index_runs(text: Column) -> Column:
    """The runs of letters and digits of which ``index_tokens`` makes its terms, with a space between two; CJK characters are not set apart yet."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def query_tokens(text: Column) -> Column:
    """Distinct ASCII terms of a query, without stop words and single characters."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(rules.STOPWORDS))


def query_cjk(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"[{rules.CJK}]"), 0))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode's compatibility form, for which there is no built-in."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalize_query(text: Column) -> Column:
    """Compatibility form, trimmed, single spaces."""
    return F.regexp_replace(trimmed(nfkc(text)), r"(?U)\s+", " ")


def query_language(text: Column) -> Column:
    return F.when(text.rlike(f"[{rules.CJK}]"), "zh").otherwise("en")


def query_intent(text: Column) -> Column:
    return F.when(text.rlike(rules.RELEASE), "release").when(text.rlike(rules.TROUBLE), "trouble").when(text.rlike(rules.HOWTO), "howto").otherwise("neutral")


def source_type(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(p.contains("release") | p.rlike(r"/v[-_.]?\d"), "release").when(p.contains("faq") | p.contains("troubleshoot"), "faq")
        .when(p.contains("getting-started") | p.contains("quickstart") | p.contains("getting_started"), "getting_started")
        .when(p.contains("issue") | p.contains("github.com"), "issue").otherwise("doc")
    )


def intent_route(text: Column) -> tuple[Column, Column]:
    """(chitchat, meta or kb; what matched, 60 characters at most)."""
    q = trimmed(F.coalesce(text, F.lit("")))
    chat, meta = "(?i)" + "|".join(rules.CHITCHAT), "(?i)" + "|".join(rules.META)
    is_chat, is_meta = q.rlike(chat), (F.length(q) <= rules.META_LENGTH) & q.rlike(meta)
    route = F.when(q == "", "kb").when(is_chat, "chitchat").when(is_meta, "meta").otherwise("kb")
    matched = F.when(is_chat, F.regexp_extract(q, chat, 0)).when(is_meta, F.regexp_extract(q, meta, 0))
    return route, F.when(q != "", F.substring(matched, 1, 60))


def first_rule(text: Column, table: list[tuple[str, list[str]]], default: str | None) -> Column:
    """The name of the first entry one of whose words the text contains."""
    any_of = lambda words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    out = F.when(any_of(table[0][1]), table[0][0])
    for name, words in table[1:]:
        out = out.when(any_of(words), name)
    return out.otherwise(default) if default is not None else out


def cosine(a: Column, b: Column) -> Column:
    """Inner product of two vectors, which is their cosine if both have unit length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sentences(text: Column) -> Column:
    """Trimmed sentences: cut after 。 ! ? ; , after . before white space, and at blank lines."""
    parts = F.split(text, r"(?<=[。!?;])|(?<=[.!?;])\s+|\n{2,}")
    return F.filter(F.transform(parts, trimmed), lambda s: s != "")


def verifier_sentences(text: Column) -> Column:
    """Trimmed sentences as a verifier takes them: cut after every 。 ! ? and . whatever follows, and at line ends."""
    parts = F.split(text, r"(?U)(?<=[。!?.])\s+|(?<=[。!?.])(?=\S)|\n+")
    return F.filter(F.transform(parts, trimmed), lambda s: s != "")


ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def entity_names() -> Column:
    """Name to text of the named references of HTML; numbers 128 to 159 are taken as Windows does, as browsers take them."""
    named = {k.rstrip(";"): v for k, v in html5.items() if k.endswith(";")} | {f"#{n}": bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}
    return F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*map(F.lit, named.values())))


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal references decoded, once each; unknown ones stay.

    The different references of a text are replaced one after another. Those for an ampersand become a character that no text
    holds until the others are done, so that what they complete is not decoded again.
    """
    hold = "\uffff"

    def decoded(e: Column) -> Column:
        body = F.substring(e, 2, 40).substr(F.lit(1), F.length(e) - 2)
        number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 10), 16, 10)).when(body.startswith("#"), F.substring(body, 2, 10)).cast("long")
        code = F.when((number >= 1_114_112) | number.between(0xD800, 0xDFFF) | (number == 0), F.lit(0xFFFD)).otherwise(number)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        name = F.when(number.isNotNull(), F.concat(F.lit("#"), code.cast("string"))).otherwise(body)
        return F.coalesce(F.try_element_at(entity_names(), name), F.when(number.isNotNull(), char), e)

    found = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), 0)), lambda e: F.struct(e.alias("e"), decoded(e).alias("x")))
    put = F.aggregate(found, text, lambda t, r: F.replace(t, r["e"], F.when(r["x"] == "&", hold).otherwise(r["x"])))
    return F.when(text.contains("&"), F.replace(put, F.lit(hold), F.lit("&"))).otherwise(text)
