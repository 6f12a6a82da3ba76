"""Text primitives as Column functions. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.values import ABSTAIN_PHRASES, STOPWORDS


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once per row, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), lambda bound: fn(bound)), F.lit(0))


def words_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(x: Column | str) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def squeeze(x: Column | str) -> Column:
    """White space runs as single blanks, ends stripped."""
    return strip(F.regexp_replace(col(x), r"(?U)\s+", " "))


def tokens(x: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(x)), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(x: Column | str, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Tokens of three characters or more that are no stop words."""
    long = F.filter(tokens(x), lambda t: F.length(t) > 2)
    return F.filter(long, lambda t: ~t.isin(*stopwords)) if stopwords else long


def normalized(x: Column | str) -> Column:
    """Lower case, everything but letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", " "))


def lowered_squeezed(x: Column | str) -> Column:
    return squeeze(F.lower(col(x)))


def contains_any(x: Column | str, phrases: Sequence[str]) -> Column:
    """Whether any phrase is a substring."""
    out = F.lit(False)
    for phrase in phrases:
        out = out | col(x).contains(phrase)
    return out


def distinct_ignoring_case(values: Column | str) -> Column:
    """Stripped values without blanks and without repeats in another case; the first spelling stays."""
    clean = F.filter(F.transform(col(values), strip), lambda v: v != "")
    first = lambda both: F.filter(both["clean"], lambda v, i: F.array_position(both["keys"], F.lower(v)) == i + 1)
    return let(clean, lambda c: let(F.struct(c.alias("clean"), F.transform(c, F.lower).alias("keys")), first))


def clean_list(values: Column | str) -> Column:
    """Stripped values without blanks; an empty list for null."""
    return F.coalesce(F.filter(F.transform(col(values), strip), lambda v: v != ""), F.array().cast("array<string>"))


def sentences(x: Column | str, least: int = 10) -> Column:
    """Sentences of ``least`` characters or more, cut after . ! ? and at line feeds."""
    return F.filter(F.transform(F.split(col(x), r"(?U)(?<=[.!?])\s+|\n+"), strip), lambda s: F.length(s) >= least)


def best_sentence(x: Column | str, most: int = 320) -> Column:
    """The longest sentence, the first of equals, cut to ``most`` characters."""
    parts = F.filter(F.transform(F.split(col(x), r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")
    sized = lambda p: let(F.struct(p.alias("p"), F.array_max(F.transform(p, F.length)).alias("n")), lambda b: F.get(F.filter(b["p"], lambda s: F.length(s) == b["n"]), F.lit(0)))
    return F.substring(F.coalesce(let(parts, sized), strip(x)), 1, most)


def sentence_windows(x: Column | str, most: int = 24) -> Column:
    """Sentences and pairs of neighbours in order, without repeats but for case and white space."""
    pairs = lambda p: F.flatten(F.transform(p, lambda s, i: F.when(F.get(p, i + 1).isNotNull(), F.array(s, F.concat_ws(" ", s, F.get(p, i + 1)))).otherwise(F.array(s))))
    keyed = lambda w: F.struct(w.alias("w"), F.transform(w, lambda v: F.trim(F.regexp_replace(F.lower(v), r"(?U)\s+", " "))).alias("k"))
    first = lambda b: F.filter(b["w"], lambda v, i: F.array_position(b["k"], F.get(b["k"], i)) == i + 1)
    windows = let(sentences(x), lambda p: let(pairs(p), lambda w: let(keyed(w), first)))
    compact = let(squeeze(x), lambda c: F.when(c != "", F.array(F.substring(c, 1, 1200))).otherwise(F.array().cast("array<string>")))
    return let(windows, lambda w: F.when(F.size(w) > 0, F.slice(w, 1, most)).otherwise(compact))


def citations(x: Column | str) -> Column:
    """Distinct chunk ids in square brackets, comma separated, with or without ``chunk_id:``."""
    groups = F.regexp_extract_all(col(x), F.lit(r"\[([^\]]+)\]"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    bare = F.transform(parts, lambda p: strip(F.regexp_replace(strip(p), r"(?i)^chunk_id:\s*", "")))
    return F.array_distinct(F.filter(bare, lambda p: p.contains("__")))


def abstained(x: Column | str) -> Column:
    return contains_any(F.lower(col(x)), ABSTAIN_PHRASES)


def doc_prefix(x: Column | str) -> Column:
    """What stands before the last double underscore; all, without one."""
    return F.regexp_replace(col(x), "(?s)^(.*)__.*$", "$1")


def json_object(x: Column | str, schema: str) -> Column:
    """An object from JSON, from JSON in a code fence, or from the outermost braces; null if all fail."""
    raw = strip(x)
    bare = strip(F.regexp_replace(F.regexp_replace(raw, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    tried = [F.when(c.startswith("{") & c.endswith("}"), F.from_json(c, schema)) for c in (raw, bare, inner)]
    return F.coalesce(*tried)


def epoch_seconds(x: Column | str) -> Column:
    """Whole seconds of a numeric string, or null."""
    return F.trim(col(x)).try_cast("double").cast("long")


def rounded(x: Column | str, digits: int = 6) -> Column:
    return F.round(col(x), digits)


def overlap_share(query: Column, vocabulary: Column) -> Column:
    """Distinct query tokens that the vocabulary holds, as a share; 0 without query tokens."""
    asked = F.array_distinct(query)
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, vocabulary)) / F.size(asked))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Shared tokens as a share of the smaller set; 0 if one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / least)


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def unit(x: Column | str) -> Column:
    """A vector divided by its length."""
    norm = F.sqrt(dot(x, x)) + F.lit(1e-12)
    return F.transform(col(x), lambda v: v.cast("double") / norm)


def token_count(x: Column | str) -> Column:
    """The offline estimate: a token for four characters, at least one unless empty."""
    size = F.length(col(x))
    return F.when(size == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(size / 4).cast("int")))


def truncated(x: Column | str, count: Column | int) -> Column:
    """The offline cut to a number of tokens; ends are stripped."""
    n = F.lit(count) if isinstance(count, int) else count
    return strip(F.substring(col(x), F.lit(1), (n * 4).cast("int")))
