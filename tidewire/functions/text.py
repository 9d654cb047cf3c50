"""Functions on strings as column expressions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities decoded in feeds, in this order, and in titles.
HTML_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&#x27;", "'"))
TITLE_ENTITIES = ("amp", "lt", "gt", "quot", "#39")
#: Words that say nothing about a title.
STOPWORDS = (
    "the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "as", "at",
    "by", "is", "are", "was", "were", "be", "been", "with", "from", "after",
    "over", "under", "amid", "says", "say", "said", "report", "reports",
    "news", "update", "live", "breaking", "its", "his", "her", "their",
    "this", "that", "these", "those", "it", "he", "she", "they", "we", "you",
    "not", "no", "new", "us", "into", "than", "but", "will", "has", "have",
    "had",
)
#: White space of every kind, inside a class of characters.
SPACES = "\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _replaced(text: Column, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def _once(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is named there."""
    return F.transform(F.array(value), use)[0]


def strip_html(text) -> Column:
    """Text without tags; entities decoded, white space collapsed; tags that decoding made go too."""
    tag = "<[^>]*>"
    out = _replaced(F.regexp_replace(_c(text), tag, " "), HTML_ENTITIES)
    out = F.regexp_replace(F.regexp_replace(out, "&#x?[0-9a-fA-F]+;", ""), tag, " ")
    return F.trim(F.regexp_replace(out, "[ \\t\\n\\x0B\\f\\r]+", " "))


def extract_tag(xml, tag: str) -> Column:
    """Content of an element's first occurrence, a CDATA section before plain text; empty if there is none."""
    cdata = F.regexp_extract(_c(xml), f"(?is)<{tag}[^>]*>[ \\t\\n\\r]*<!\\[CDATA\\[(.*?)\\]\\]>", 1)
    plain = F.regexp_extract(_c(xml), f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return F.trim(F.coalesce(F.nullif(cdata, F.lit("")), plain))


def extract_attr(xml, tag: str, attr: str) -> Column:
    return F.regexp_extract(_c(xml), f'(?is)<{tag}[^>]*[ \\t\\n\\r]{attr}="([^"]*)"', 1)


def normalize_title(title) -> Column:
    """Lower-cased title without signs other than a-z, 0-9 and single spaces.

    Entities go whole, as all they stand for are other signs.
    """
    out = F.regexp_replace(F.regexp_replace(F.lower(_c(title)), f"&(?:{'|'.join(TITLE_ENTITIES)});", ""), f"[^a-z0-9{SPACES}]", "")
    return F.trim(F.regexp_replace(out, f"[{SPACES}]+", " "))


def title_signature(title) -> Column:
    """The first six of the title's distinct telling words in alphabetical order; the whole title if it has none."""

    def signed(plain: Column) -> Column:
        words = F.filter(F.split(plain, " "), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))
        joined = F.array_join(F.slice(F.array_sort(F.array_distinct(words)), 1, 6), "|")
        return _once(joined, lambda j: F.when(j == "", plain).otherwise(j))

    return _once(normalize_title(title), signed)


def host(url) -> Column:
    """Lower-cased host with a port that isn't the scheme's own; null if the address can't be parsed."""
    authority = F.regexp_replace(F.try_parse_url(_c(url), F.lit("AUTHORITY")), "^.*@", "")
    default = F.when(F.try_parse_url(_c(url), F.lit("PROTOCOL")) == "https", ":443$").otherwise(":80$")
    return F.lower(F.regexp_replace(authority, default, F.lit("")))


def content_hash(title, link) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(_c(title)), "[ \\t\\n\\r]+", " "))
    return F.sha2(F.concat_ws("|", plain, F.coalesce(host(link), _c(link))), 256)


def domain(url) -> Column:
    return F.coalesce(F.regexp_replace(host(url), ":[0-9]+$", ""), F.lit(""))


def sanitize_url(url) -> Column:
    """The address if it is http or https, else an empty string."""
    return F.when(F.try_parse_url(_c(url), F.lit("PROTOCOL")).isin("http", "https"), _c(url)).otherwise("")


def strip_punctuation(text) -> Column:
    return F.regexp_replace(_c(text), "[^\\p{L}\\p{N} \\t\\n\\r]", "")


def trim_punctuation(text) -> Column:
    return F.regexp_replace(_c(text), "[.,;:!?]+$", "")


#: Corporate endings of which one is dropped from the end of a name.
CORPORATE_ENDINGS = ("inc", "ltd", "llc", "corp", "plc", "ag", "gmbh")


def normalize_name(name) -> Column:
    """Lower-cased name in compatibility form, without combining marks and one corporate ending, white space collapsed."""
    held = F.coalesce(_c(name), F.lit(""))
    plain = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), held, F.lit(True))
    plain = F.lower(F.regexp_replace(plain, "[\\u0300-\\u036f]", ""))
    plain = F.trim(F.regexp_replace(plain, f"[{SPACES}]+", " "))
    plain = F.regexp_replace(plain, f"(?<=[^ ]) (?:{'|'.join(CORPORATE_ENDINGS)})\\.?\\z", "")
    return F.when(_c(name).isNotNull(), plain)


def name_or_itself(name) -> Column:
    """A normalised name, or the name itself where nothing is left of it."""
    return F.coalesce(F.nullif(normalize_name(name), F.lit("")), _c(name))


def name_key(name) -> Column:
    """A normalised name without punctuation, as similar names are compared."""
    return F.trim(F.regexp_replace(strip_punctuation(normalize_name(name)), f"[{SPACES}]+", " "))


def image_url(html) -> Column:
    """An item's picture: the first of ten places that holds one; empty if none does."""
    html = F.coalesce(_c(html), F.lit(""))
    text = F.coalesce(*[F.nullif(extract_tag(html, t), F.lit("")) for t in ("description", "content:encoded", "content", "summary")], F.lit(""))
    decoded = _replaced(text, (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&amp;", "&")))
    first = lambda source, pattern: F.regexp_extract(source, "(?i)" + pattern, 1)
    linked = lambda place: F.when(F.startswith(place, F.lit("http")), place)
    picture = "<img[^>]+src=[\"']([^\"']+)[\"']"
    places = [
        first(html, '<media:content[^>]+url="([^"]+\\.(?:jpg|jpeg|png|webp|gif)[^"]*)"'),
        first(html, '<media:content[^>]+medium="image"[^>]+url="([^"]+)"'),
        first(html, '<media:content[^>]+url="([^"]+)"[^>]+medium="image"'),
        first(html, '<media:content[^>]+url="(https?://[^"]+)"'),
        first(html, "<media:thumbnail[^>]+url=[\"']([^\"']+)[\"']"),
        first(html, '<enclosure[^>]+url="([^"]+)"[^>]+type="image/[^"]+"'),
        first(html, '<enclosure[^>]+type="image/[^"]+"[^>]+url="([^"]+)"'),
        linked(extract_tag(extract_tag(html, "image"), "url")),
        linked(first(text, picture)),
        linked(first(decoded, picture)),
    ]
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in places], F.lit(""))


def source_image_url(link, source_url) -> Column:
    """The address of the icon of a link's host, or else of its source's; empty without a host."""
    own = F.coalesce(F.nullif(domain(link), F.lit("")), F.nullif(domain(source_url), F.lit("")))
    return F.coalesce(F.concat(F.lit("https://www.google.com/s2/favicons?domain="), F.url_encode(own), F.lit("&sz=128")), F.lit(""))


def plural(count, noun: str) -> Column:
    """A count with its noun."""
    return F.concat(_c(count).cast("string"), F.lit(f" {noun}"), F.when(_c(count) == 1, "").otherwise("s"))


def match_title(title) -> Column:
    """A wiki title as it is compared: underscores are spaces, whatever the case."""
    return F.lower(F.trim(F.replace(_c(title), F.lit("_"), F.lit(" "))))


def exception_text(name, message) -> Column:
    """An exception as a sample: its name of 40 signs at most, and 160 signs of its message without addresses."""
    plain = F.substring(F.regexp_replace(F.coalesce(_c(name), F.lit("Error")), "[^A-Za-z0-9_.]", ""), 1, 40)
    return F.concat(plain, F.lit(": "), F.substring(redact_urls(F.coalesce(_c(message), F.lit(""))), 1, 160))


def redact_urls(text) -> Column:
    return F.regexp_replace(_c(text), "[A-Za-z][A-Za-z0-9+.-]*://[^ \\t\\n\\r]+", "[url]")


def pair_key(a, b) -> Column:
    return F.concat_ws("|", F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)))
