"""Gates and classification of news texts by ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence of a match in the title and in the body, for events that are looked for and for others.
TITLE, BODY, OTHER_TITLE, OTHER_BODY = 0.90, 0.70, 0.80, 0.60


#: Rules of a gate in order: the tag of a rejection, the signals that have to be there, those that must not, and the signal whose words the tag quotes.
#: A signal is looked for in the address (``url:``), in address and text (``text:``) or in either (``any:``).
GATE_RULES = (
    ("womens_url", ("url:womens",), (), None),
    ("womens_text", ("text:womens",), (), "womens"),
    ("conflicting_signals", ("any:football", "any:wanted"), (), None),
    ("football_url", ("url:football",), (), None),
    ("football_text", ("text:football",), (), "football"),
    ("other_text", ("text:other",), ("any:wanted",), "other"),
)


def topic_gate(url: Column, title: Column, body: Column, urls: dict[str, str], texts: dict[str, str], rules=GATE_RULES) -> Column:
    """Struct (kept, reason): the first rule that holds rejects a text; one that none rejects is kept.

    ``urls`` and ``texts``: a regular expression for each signal, in addresses and in whole texts; a signal without one is never there.
    """
    address = F.coalesce(url, F.lit(""))
    whole = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")), address)

    def words(signal: str) -> Column:
        return F.nullif(F.regexp_extract(whole, texts[signal], 0), F.lit("")) if signal in texts else F.lit(None).cast("string")

    def there(test: str) -> Column:
        where, signal = test.split(":")
        in_url = address.rlike(urls[signal]) if signal in urls else F.lit(False)
        return in_url if where == "url" else words(signal).isNotNull() if where == "text" else in_url | words(signal).isNotNull()

    reason = F.lit(None).cast("string")
    for tag, needed, barred, quoted in reversed(rules):
        holds = F.lit(True)
        for test in needed:
            holds = holds & there(test)
        for test in barred:
            holds = holds & ~there(test)
        reason = F.when(holds, F.concat(F.lit(f"{tag}:"), words(quoted)) if quoted else F.lit(tag)).otherwise(reason)
    return F.struct(reason.isNull().alias("kept"), reason.alias("reason"))


def classify_event(title: Column, body: Column, events: dict[str, str], targets: tuple[str, ...] | None = None, threshold: float = 0.5) -> Column:
    """Struct (event, confidence, above): the pattern (``events``: a regular expression for each) with the surest match, a title before a body; the first listed on ties."""
    targets = tuple(events) if targets is None else targets
    t, b = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    sure = [F.when(t.rlike(p), TITLE if e in targets else OTHER_TITLE).when(b.rlike(p), BODY if e in targets else OTHER_BODY) for e, p in events.items()]
    found = F.array_sort(F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct((-c).alias("minus"), F.lit(k).alias("k"), F.lit(e).alias("event"))) for k, (e, c) in enumerate(zip(events, sure))])))
    best = F.get(found, F.lit(0))
    confidence = F.coalesce(-best["minus"], F.lit(0.0))
    return F.struct(F.coalesce(best["event"], F.lit("unknown")).alias("event"), confidence.alias("confidence"), (confidence >= threshold).alias("above"))


def verdict_text(level: Column, n: Column, rate: Column, comps: Column) -> Column:
    """Sentences by the level that an estimate rests on, with its precedents."""
    base = (
        F.when(level == "cell", F.format_string("Based on %d comparable transfers in this exact situation.", n))
        .when(level == "pair", F.format_string("Based on %d transfers between these styles.", n))
        .when(level == "cluster", F.format_string("Based on %d transfers of this player type.", n))
        .otherwise("Based on the overall rate, as there is no precedent.")
    )
    verdict = F.when(rate >= 0.65, "A likely success").when(rate >= 0.5, "More likely than not").when(rate >= 0.35, "A risk").otherwise("Unlikely")
    like = F.when(F.size(comps) > 0, F.concat(F.lit(" Similar cases: "), F.array_join(comps, ", "), F.lit(".")))
    return F.concat(F.format_string("%s (%d%%). ", verdict, F.round(rate * 100).cast("int")), base, F.coalesce(like, F.lit("")))
