"""Word lists applied to texts: advertising, urgency, sentiment, acronyms, names, products and dictionaries.

Words are those of ASCII patterns: a letter with an accent ends a word, as in the patterns' home.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values

#: Parts of links that mark advertising.
AD_LINKS = (
    "/cnn-underscored", "/deals/", "/shopping/", "/ad/", "/sponsored/", "/partner-content/", "/brandcontent/",
    "/paid-partner/", "/commerce/", "/coupons/", "/product-reviews/", "affiliate", "/buy/", "/shop/",
)

#: Patterns of advertising titles, whatever their case.
AD_TITLES = (
    r"^ad:",
    r"^sponsored",
    r"^promoted",
    r"^advertisement",
    r"^underscored",
    r"cnn underscored",
    r"best .{0,30} deals",
    r"best .{0,30} to buy",
    r"best .{0,30} for 20\d\d",
    r"best .{0,30} we'?ve tested",
    r"our favorite .{0,40} of 20\d\d",
    r"top \d+ .{0,30} (deals|products|gifts)",
    r"shop .{0,30} sale",
    r"\d+% off .{0,30}",
    r"coupon code",
    r"promo code",
    r"gift guide",
    r"deals of the day",
    r"sale alert",
    r"save \$?\d+",
    r"discount code",
    r"black friday",
    r"cyber monday",
    r"prime day",
    r"where to buy",
    r"buying guide",
    r"price drop",
    r"cash ?back card",
    r"home equity (loan|line|into cash)",
    r"home equity\z",
    r"into cash you can use",
    r"cash out of your home",
    r"credit card interest",
    r"avoid .{0,20}credit card",
    r"intro apr",
    r"\d+% apr",
    r"0% .{0,15}(apr|interest|intro)",
    r"balance transfer",
    r"best .{0,20} card of",
    r"best .{0,20} credit card",
    r"best .{0,20} rewards card",
    r"best .{0,20} travel card",
    r"best .{0,20} savings (account|rate)",
    r"high.yield savings",
    r"refinanc(e|ing) (your|a|the)",
    r"mortgage rate",
    r"insurance (rate|quote|plan)",
    r"personal loan",
    r"debt (consolidat|relief|pay)",
    r"student loan (refin|forgiv|rate)",
    r"experts:.{0,30}(card|loan|rate|account|insur)",
    r"it'?s official:.{0,30}(card|credit|interest|rate|apr)",
    r"dream big with",
    r"rising .{0,15}equity",
    r"turn your .{0,30}(equity|home)",
    r"want cash .{0,20}(out|from) .{0,15}home",
    r"\b(visa|mastercard|amex|discover)\b.{0,20}(card|offer|reward)",
    r"subscribe (now|today|to)",
    r"sign up for .{0,20} newsletter",
    r"download our app",
    r"^horoscope",
    r"^daily horoscope",
    r"^your .{0,15} horoscope",
    r"^crossword",
    r"^wordle",
    r"^today.s puzzle",
)

#: Patterns of financial advertising in titles, whatever their case.
FINANCIAL_AD_TITLES = (
    r"credit card",
    r"cash ?back",
    r"home equity",
    r"\bapr\b",
    r"\bloan\b",
    r"\bmortgage\b",
    r"\brefinanc",
    r"\binsurance\b.{0,15}(rate|quote|plan|cost)",
    r"\bsavings (account|rate)",
    r"\binterest rate",
    r"\bdebt (consolidat|relief|pay)",
    r"your (home|money|credit|debt|rate|savings|equity)",
    r"experts:.{0,5}(this|the|best)",
    r"it'?s official",
    r"dream big",
    r"cash (out|you can)",
    r"turn your",
    r"\b(visa|mastercard|amex)\b",
    r"\bintro (rate|apr|offer)",
    r"\b0%.{0,10}(apr|interest|intro)",
    r"best .{0,20}(card|rate|account)",
    r"avoid .{0,15}(interest|fee|charge)",
    r"high.yield",
    r"\bCD rate",
    r"balance transfer",
    r"personal (loan|finance)",
    r"student loan",
)

#: How categories begin, by level; the first level that fits counts.
URGENCY = (
    ("critical", ("conflict", "cyber", "military", "radiation", "space weather")),
    ("warning", ("natural disaster", "health", "displacement")),
    ("advisory", ("government", "sanctions", "aviation")),
    ("monitoring", ("economic", "supply chain", "prediction", "trade", "humanitarian")),
    ("system", ("infrastructure", "ai/ml", "caching", "compute", "proxy", "imagery", "visual")),
)
URGENCY_LEVELS = (*(level for level, _ in URGENCY), "neutral")

#: Words of ill and of good tone.
NEGATIVE = (
    "kill", "killed", "killing", "dead", "death", "dies", "died", "war", "attack", "bomb", "bombing",
    "strike", "missile", "terror", "terrorist", "terrorism", "explosion", "crash", "crisis", "threat",
    "threaten", "conflict", "violence", "violent", "destroy", "destroyed", "destruction", "collapse",
    "sanctions", "sanction", "condemn", "condemned", "arrest", "arrested", "fraud", "corruption",
    "scandal", "protest", "riots", "riot", "flee", "fled", "refugees", "famine", "drought", "flood",
    "earthquake", "hurricane", "tornado", "devastat", "catastroph", "emergency", "victim", "victims",
    "shoot", "shooting", "shot", "hostage", "kidnap", "torture", "abuse", "massacre", "genocide",
    "invasion", "invaded", "nuclear", "weapon", "casualties", "wounded", "injured", "suffer",
    "fail", "failed", "failure", "recession", "downturn", "unemployment", "poverty", "hunger",
    "disease", "pandemic", "epidemic", "outbreak", "infection", "contamination",
)
POSITIVE = (
    "peace", "ceasefire", "agreement", "deal", "treaty", "accord", "cooperation", "aid", "help",
    "rescue", "rescued", "relief", "recovery", "recover", "growth", "prosper", "success",
    "elect", "elected", "democratic", "freedom", "liberat", "reform", "progress", "improve",
    "breakthrough", "milestone", "achievement", "victory", "win", "won", "celebrate", "hope",
    "safe", "secure", "security", "protect", "humanitarian", "donate", "donation", "support",
    "build", "rebuild", "develop", "development", "summit", "diplomacy", "diplomatic", "negotiate",
    "resolution", "resolve", "reconciliation", "reunite", "alliance", "partner", "partnership",
)
#: A word counts by its beginning if that is a listed word of so many letters.
STEM = 6

#: Acronyms that name no one.
ACRONYM_STOPLIST = (
    "AI", "AKA", "AM", "APP", "ASAP", "BST", "CEO", "CFO", "COO", "CPI", "CTO",
    "DIY", "ETA", "EUR", "EV", "FAQ", "FYI", "GDP", "GMT", "GPS", "HR", "ID",
    "IPO", "IT", "JR", "ML", "NEW", "OK", "PDF", "PM", "PR", "Q1", "Q2", "Q3",
    "Q4", "SR", "TV", "URL", "USD", "VIP", "VP", "VPN",
)

#: Capitalised phrases that are no person.
PERSON_STOPLIST = (
    "New Year", "Good Friday", "Black Friday", "Cyber Monday",
    "Prime Minister", "President Trump", "President Biden", "President Putin",
    "Vice President", "Secretary General", "Secretary State",
    "Chief Justice", "Attorney General", "Joint Chiefs",
    "King Charles", "Pope Francis",
    "Al Jazeera", "Fox News", "Sky News", "Wall Street",
    "New York", "Los Angeles", "San Francisco", "Las Vegas",
    "Hong Kong", "Sri Lanka", "South Korea", "North Korea",
    "South Africa", "New Zealand", "El Salvador", "Costa Rica",
    "Sierra Leone", "Burkina Faso", "Ivory Coast",
    "White House", "Capitol Hill", "Downing Street",
    "World Cup", "Olympic Games", "Nobel Prize",
    "Supreme Court", "World Bank", "Red Cross", "Red Sea",
    "Black Sea", "South China", "East China",
    "Breaking News", "Live Updates", "Just In",
    "Read More", "Click Here", "Sign Up",
    "Photo Credit", "Getty Images", "Associated Press",
    "Bangkok Post", "The Hill", "The Times", "The Intercept",
    "The Guardian", "The Telegraph", "Hacker News",
    "War Zone", "Military Times", "Task Purpose",
    "Chosun Ilbo", "El Pais",
    "Air Force", "Coast Guard", "National Guard",
    "Samsung Electronics", "Atlantic Council",
    "World Food", "Food Programme",
    "Homeland Security", "Ben Gurion",
    "United Nations", "European Union",
    "Read Full", "Full Article",
    "Morning Briefing", "Evening Briefing",
    "World War", "Cold War", "Civil War",
    "Black Hawk", "Golden Fleet", "Epic Fury",
    "Power Plants", "Fort Bragg",
)

#: Words that no person's name holds.
NO_NAME_WORDS = (
    "post", "times", "news", "zone", "journal", "monitor", "tribune",
    "herald", "gazette", "observer", "telegraph", "intercept", "briefing",
    "digest", "report", "review", "service", "english",
    "force", "forces", "security", "organization", "organisation", "programme",
    "program", "affairs", "council", "committee", "ministry", "bureau",
    "agency", "command", "corps", "division", "department", "commission",
    "authority", "institute", "association", "foundation", "federation",
    "airport", "material", "materials", "plants", "plant", "nuclear",
    "vulnerability", "vulnerabilities", "exploited", "fleet", "awards",
    "network", "operating", "innovation", "revolution", "operations",
    "war", "article", "full", "read", "says", "adds", "known", "linked",
    "uses", "stealthy", "morning", "afternoon", "evening", "update",
    "special", "general", "fury", "hawk", "leaving",
    "international", "humanitarian", "population", "world",
)
FILLERS = (
    "the", "on", "in", "at", "of", "for", "and", "or", "but", "why",
    "how", "who", "what", "when", "where", "its", "his", "her", "our",
    "their", "this", "that", "one", "two", "most", "some", "all", "any",
    "new", "old", "big", "very", "just", "also", "than", "each",
)

#: Titles before a name, tried in this order.
NAME_TITLES = (
    "president", "vice president", "director", "secretary", "minister",
    "prime minister", "senator", "governor", "ambassador", "chairman",
    "general", "admiral", "colonel", "major", "captain", "commander",
    "chief", "state", "deputy", "former",
)

#: Tokens that look like products and are none.
PRODUCT_STOPLIST = ("covid-19", "covid19", "24/7", "9/11", "401k", "y2k")

# ----------------------------------------------------------------

#: Borders of an ASCII word, as \b is wider here.
_BEGIN, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: White space of every kind.
SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: The most terms that go to every task; more meet the texts by a join.
FEW_TERMS = 50_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any(patterns) -> str:
    return "(?i)(?:" + "|".join(p.replace("\\b", _EDGE) for p in patterns) + ")"


def is_ad(title, summary, link, links=AD_LINKS, titles=AD_TITLES) -> Column:
    """Whether a link, a title or the whole text has marks of advertising."""
    text = F.concat_ws(" ", F.coalesce(_c(title), F.lit("")), F.coalesce(_c(summary), F.lit("")))
    link = F.lower(F.coalesce(_c(link), F.lit("")))
    by_link = F.exists(F.array(*map(F.lit, links)), lambda s: F.contains(link, s))
    paid = text.rlike("(?i)paid (content|partner|post|promotion)")
    affiliate = text.rlike(_any(["\\baffiliate\\b"])) & text.rlike(_any(["\\b(link|commission|earn)\\b"]))
    return by_link | F.coalesce(_c(title).rlike(_any(titles)), F.lit(False)) | paid | affiliate


def is_financial_ad(title, titles=FINANCIAL_AD_TITLES) -> Column:
    return F.coalesce(_c(title).rlike(_any(titles)), F.lit(False))


def urgency(category, levels=URGENCY) -> Column:
    """The first level of whose beginnings the category has one; neutral if none."""
    plain, out = F.lower(F.coalesce(_c(category), F.lit(""))), None
    for level, starts in levels:
        test = F.exists(F.array(*map(F.lit, starts)), lambda s: F.startswith(plain, s))
        out = F.when(test, level) if out is None else out.when(test, level)
    return out.otherwise("neutral")


def sentiment(text, positive=POSITIVE, negative=NEGATIVE) -> Column:
    """Balance of listed words over the square root of the number of words, from -1 to 1.

    A listed word counts for its own list, one of both for the negative.  Another word
    counts for each list of which it begins with a word of STEM letters or more.  Empty
    words, as before a text's first and after its last sign, add to the number.
    """
    words = F.split(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-zA-Z0-9_]+")

    firsts = sorted({w[:STEM] for w in (*positive, *negative) if len(w) >= STEM})

    def begins(listed) -> str:
        stems = [w for w in listed if len(w) >= STEM]
        return f"^(?:{'|'.join(stems)})" if stems else "^(?!)"

    def worth(w: Column) -> Column:
        stems = w.rlike(begins(positive)).cast("int") - w.rlike(begins(negative)).cast("int")
        # a look at the first letters spares most words the search for what they begin with
        may_begin = F.substring(w, 1, STEM).isin(*firsts) if firsts else F.lit(False)
        return F.when(w.isin(*negative), -1).when(w.isin(*positive), 1).when(may_begin, stems).otherwise(0)

    def balance(words: Column) -> Column:
        score = F.aggregate(words, F.lit(0), lambda total, w: total + worth(w))
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score / F.greatest(F.lit(1.0), F.sqrt(F.size(words).cast("double")))))

    # words are bound to a name, or the text would be split for each use of them
    return F.transform(F.array(words), balance)[0]


def _distinct_matches(text, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(f"{_BEGIN}({pattern}){_END}"), F.lit(1)))


def acronyms(text, known=None, stoplist=ACRONYM_STOPLIST) -> Column:
    """Distinct runs of two to five capitals and digits that begin with a capital, in the order of letters.

    known: an array of lower-case dictionary terms, which are left out.
    """
    found = F.filter(_distinct_matches(text, "[A-Z][A-Z0-9]{1,4}"), lambda w: ~w.isin(*stoplist))
    if known is not None:
        found = F.filter(found, lambda w: ~F.array_contains(_c(known), F.lower(w)))
    return F.array_sort(found)


def person_names(text, stoplist=PERSON_STOPLIST) -> Column:
    """Distinct runs of two or three capitalised words that are on no list, in the order of letters."""
    lowered = [s.lower() for s in stoplist]
    found = _distinct_matches(text, f"[A-Z][a-z]+(?:{SPACE}+[A-Z][a-z]+){{1,2}}")
    return F.array_sort(F.filter(found, lambda w: ~F.lower(w).isin(*lowered)))


def plausible_names(text, known, sources) -> Column:
    """Names of persons: ``person_names`` that pass for one, without a title before them.

    known: an array of the text's dictionary entries; a name that is or holds one falls.
    sources: an array of lower-case names of sources.
    """
    known, sources = F.coalesce(_c(known), F.array().cast("array<string>")), _c(sources)

    def plausible(name: Column) -> Column:
        words = F.split(F.lower(name), f"{SPACE}+")
        return (
            ~F.arrays_overlap(words, F.array(*map(F.lit, (*NO_NAME_WORDS, *FILLERS))))
            & ~F.exists(words, lambda w: F.length(w) < 2)
            & ~F.array_contains(sources, F.lower(name))
            & ~F.exists(known, lambda k: F.contains(F.lower(name), F.lower(k)))
        )

    def untitled(name: Column) -> Column:
        rest = None
        for title in NAME_TITLES:
            test, cut = F.startswith(F.lower(name), F.lit(title + " ")), F.substr(name, F.lit(len(title) + 2))
            rest = F.when(test, cut) if rest is None else rest.when(test, cut)
        words = F.split(rest, f"{SPACE}+")
        whole = (F.size(words) >= 2) & ~F.exists(words, lambda w: F.length(w) < 2)
        return F.when(rest.isNotNull() & whole, rest).otherwise(name)

    return F.array_sort(F.array_distinct(F.transform(F.filter(person_names(text), plausible), untitled)))


def source_names(names: Column) -> Column:
    """Lower-case names of sources and their parts between dashes, bars and colons, from an array of names."""
    parts = F.flatten(F.transform(names, lambda n: F.split(n, f"{SPACE}*[-–—|:]{SPACE}*")))
    lowered = F.transform(F.concat(names, parts), lambda n: F.lower(F.trim(n)))
    return F.array_sort(F.array_distinct(lowered))


def products(text, known=None) -> Column:
    """Distinct tokens that look like products: with a digit and of three signs or more, or with a capital inside."""
    digits = F.filter(_distinct_matches(text, "[A-Z][a-zA-Z0-9-]*[0-9][a-zA-Z0-9-]*"), lambda w: F.length(w) >= 3)
    found = F.array_union(digits, _distinct_matches(text, "[A-Z][a-z]+[A-Z][a-zA-Z]*"))
    found = F.filter(found, lambda w: ~F.lower(w).isin(*PRODUCT_STOPLIST))
    if known is not None:
        found = F.filter(found, lambda w: ~F.array_contains(_c(known), F.lower(w)))
    return F.array_sort(found)


def _tokens(text: Column, pairs: bool) -> Column:
    """Distinct words of letters a-z of a lower-cased text; with pairs also every two signs that follow each other and are no such letters."""
    words = F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))
    if not pairs:
        return F.array_distinct(words)
    runs = F.regexp_extract_all(text, F.lit("[^a-z]{2,}"), F.lit(0))
    two = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, two))


def dictionary(terms: DataFrame) -> DataFrame:
    """A dictionary's terms, ready to be looked for: (term, canonical, type, acronym, tokens, worded).

    terms: (term, canonical, type, place).  Of terms that differ in case only the one with
    the largest place counts.  A term is an acronym if any of its forms is two to five
    signs in capitals.  Terms of less than three signs that are no acronyms are left out.
    tokens are the term's words, all of which a text that holds it has; of a term without a
    letter a-z (worded is false) its pairs of signs.
    """
    form = F.col("term")
    capitals = F.length(form).between(2, 5) & (form == F.upper(form)) & (form != F.lower(form))
    rows = terms.groupBy(F.lower("term").alias("term")).agg(F.max(F.struct("place", "canonical", "type")).alias("last"), F.bool_or(capitals).alias("acronym"))
    rows = rows.where((F.length("term") >= 3) | F.col("acronym"))
    worded = F.regexp_like("term", F.lit("[a-z]"))
    tokens = F.when(worded, _tokens(F.col("term"), False)).otherwise(_tokens(F.col("term"), True))
    return rows.select("term", "last.canonical", "last.type", "acronym", tokens.alias("tokens"), worded.alias("worded"))


def dictionary_matches(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Entries (id, canonical, type) whose term stands in a text (id, text) between signs that aren't a-z.

    terms: as for ``dictionary``; of any number of words, with any signs.  An acronym must
    stand in capitals.  Each term has one key among its tokens; a text's tokens meet the keys
    by an equal-key join, and only texts that have one are searched for the term itself.

    Up to FEW_TERMS terms go to every task, keyed by their longest word, and no text moves.
    Of more, the key is the token that the fewest texts have, so a word that a third of
    all texts hold is a key only of terms that have no other; terms with a token that no text
    has are out.  Then ids and tokens are joined, and texts come back to what they have met.
    """
    known = dictionary(terms)
    held = texts.select("id", "text").where("text is not null")
    tokens = _tokens(F.lower("text"), not known.where("not worded").isEmpty())
    if known.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
        key = F.array_max(F.transform("tokens", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
        met = held.select("id", "text", F.explode(tokens).alias("key")).join(F.broadcast(known.withColumn("key", key)), "key")
    else:
        parts = known.select("term", F.explode("tokens").alias("key"))
        hits = held.select("id", F.explode(tokens).alias("key")).join(parts.select("key").distinct(), "key", "left_semi")
        rarest = parts.join(hits.groupBy("key").agg(F.count("*").alias("n")), "key", "left").groupBy("term")
        rarest = rarest.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("rarest")).where("rarest.n > 0").select("term", "rarest.key")
        found = hits.join(known.join(rarest, "term"), "key").withColumnRenamed("id", "met_id")
        met = held.join(found, F.col("id").eqNullSafe(F.col("met_id")))
    quoted = lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    plain = F.regexp_like(F.lower("text"), F.concat(F.lit("(?<![a-z])"), quoted(F.col("term")), F.lit("(?![a-z])")))
    shouted = F.regexp_like("text", F.concat(F.lit("(?<![A-Za-z])"), quoted(F.upper("term")), F.lit("(?![A-Za-z])")))
    return met.where(F.when(F.col("acronym"), shouted).otherwise(plain)).select("id", "canonical", "type").distinct()


def is_dictionary_term(names: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds known: whether a name (name) is a term, whatever its case."""
    held = terms.select(F.lower("term").alias("key")).distinct().withColumn("known", F.lit(True))
    found = names.join(held, F.lower("name") == F.col("key"), "left").drop("key")
    return found.withColumn("known", F.coalesce("known", F.lit(False)))
