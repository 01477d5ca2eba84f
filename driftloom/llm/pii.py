"""Personal data and secrets: patterns propose spans, checksums confirm them, context words adjust the score. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import let, text_of

#: Code points on each side of a span that are searched for context words.
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    """A pattern with its guard (cheap text that must occur), validator name, score and context words. Spans below the least score are left out."""

    name: str
    pattern: str
    guard: str
    validator: str | None
    score: float
    context: str
    raised: float = 0.1
    least: float = 0.0


# The characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ DJ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())

# The patterns are linear on any text: repetitions are possessive where what follows cannot start inside them, and a match
# starts only where the run of its first characters does (or where the match before ended). Groups are repeated a bounded
# number of times, or hold one class that the rest of the text is cut at, since Java's matcher may keep each turn on its stack.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", None, 0.9, "mail|contact|write|send"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", "ip", 0.6, r"\bip\b|address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}", "luhn", 0.8, "card|credit|visa|payment|account"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "phone", 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", "mod97", 0.9, "iban|bank|account|transfer"),
    # A run of letters and digits proves nothing by itself: only words before it that name a credential raise it to its least score.
    Kind("secret", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+", r"[A-Za-z0-9_+/-]{20}", "mixed", 0.3, r"token|secret|passw|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer", 0.5, 0.5),
)
BASE = ("email", "ip", "card", "phone")

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(total: Column, x: Column, i: Column) -> Column:
        doubled = x * F.when(i % 2 == 1, 2).otherwise(1)
        return total + doubled - F.when(doubled > 9, 9).otherwise(0)

    own = F.split(F.reverse(digits), "")
    values = F.transform(own, lambda x, i: F.struct(x.try_cast("int").alias("x"), i.alias("i")))
    return F.aggregate(values, F.lit(0), lambda t, v: step(t, F.coalesce(v["x"], F.lit(0)), v["i"])) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number without blanks, its first four characters moved to the end and letters read as 10..35, is 1 modulo 97."""
    own = F.split(F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(c == "", rest).otherwise((rest * F.when(value > 9, 100).otherwise(10) + value) % 97)

    return F.aggregate(own, F.lit(0), step) == 1


def _valid(kind: Kind, found: Column) -> Column:
    digits = lambda: F.regexp_replace(found, "[^0-9]", "")
    count = F.regexp_count(found, F.lit("[0-9]"))
    if kind.validator == "ip":
        return found.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind.validator == "luhn":
        return F.when(count.between(13, 19), luhn(digits())).otherwise(F.lit(False))
    if kind.validator == "phone":
        return count.between(9, 15)
    if kind.validator == "mixed":
        return found.rlike("[0-9]") & found.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(found, ""))) >= 8)
    if kind.validator == "mod97":
        return mod97(F.replace(found, F.lit(" ")))
    return F.lit(True)


def _before(lengths: Column, block: int = 256) -> Column:
    """The sums of an array before each of its places, in time that grows with its length: sums within blocks on sums of blocks."""
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")

    def scan(values: Column) -> Column:  # exclusive, for short arrays
        start = F.struct(zero.alias("t"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(values, start, lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["a"], F.array(s["t"])).alias("a")), lambda s: s["a"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, block))
    whole = lambda parts: let(scan(F.transform(parts, lambda p: F.aggregate(p, zero, add))), lambda base: F.flatten(F.transform(parts, lambda p, i: F.transform(scan(p), lambda x: x + base[i]))))
    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(let(blocks, whole))


_SPAN = "array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>"


def _spans(text: Column, kind: Kind, context: int) -> Column:
    """The valid matches of a kind, leftmost first and not overlapping, with code-point places and scores."""

    def placed(found: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)  # what stands between the matches

        def with_starts(gap: Column) -> Column:
            steps = F.zip_with(F.slice(gap, 1, F.size(found)), found, lambda g, m: (F.char_length(g) + F.char_length(m)).cast("long"))

            def spans(before: Column) -> Column:
                def span(m: Column, i: Column) -> Column:
                    start = before[i] + F.char_length(gap[i])
                    near = F.lower(F.concat_ws(" ", F.right(gap[i], F.lit(context)), F.left(gap[i + 1], F.lit(context))))
                    score = F.round(F.lit(kind.score) + F.when(near.rlike(kind.context), kind.raised).otherwise(0.0), 2)
                    return F.when(_valid(kind, m) & (score >= kind.least), F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.char_length(m)).alias("end"), m.alias("text"), score.alias("score")))

                return F.array_compact(F.transform(found, span))

            return let(_before(steps), spans)

        any_valid = F.exists(found, lambda m: _valid(kind, m))
        return F.when(any_valid, let(gaps, with_starts))

    found = F.when(text.rlike(kind.guard), let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), placed))
    return F.coalesce(found, F.array().cast(_SPAN)).cast(_SPAN)


def find_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, context: int = CONTEXT) -> DataFrame:
    """docs with a column `pii`: an array of (kind, start, end, text, score), in the order of kinds and then by start.

    Places count code points of the whole text; ends are exclusive. Matches of a kind never overlap; a match that fails its
    validator is dropped and not tried again elsewhere. The score is the kind's, raised if a context word stands within
    `context` code points between it and its neighbours of the kind; a kind with a least score needs such words. A null or empty text has no spans. Other columns pass through; an existing `pii` is replaced.
    One projection without user functions: no shuffle, nothing that grows across rows.
    """
    text = text_of(text_col)
    return docs.withColumn("pii", F.concat(*[_spans(text, k, context) for k in kinds]))


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, min_score: float = 0.0) -> DataFrame:
    """docs with each span of at least min_score replaced by [kind]; where spans of two kinds overlap the earlier and longer one counts."""
    text = text_of(text_col)

    def cut(spans: Column) -> Column:
        order = F.array_sort(F.transform(F.filter(spans, lambda s: s["score"] >= min_score), lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["kind"].alias("k"))))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
        take = lambda s, x: F.when(x["a"] >= s["at"], F.struct((-x["b"]).alias("at"), F.concat(s["parts"], F.array(F.substring(text, (s["at"] + 1).cast("int"), (x["a"] - s["at"]).cast("int")), F.concat(F.lit("["), x["k"], F.lit("]")))).alias("parts"))).otherwise(s)
        return F.aggregate(order, start, take, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.char_length(text))))

    return find_pii(docs, text_col, kinds).withColumn(text_col, F.when(F.size("pii") > 0, cut(F.col("pii"))).otherwise(text))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
