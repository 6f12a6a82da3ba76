"""URL rules of the collector as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import values as V
from lodestone.functions.text import col, strip


def _part(url: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(url, pattern, group)


_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def scheme(url: Column) -> Column:
    return F.lower(_part(url, _SPLIT, 1))


def host(url: Column) -> Column:
    return F.lower(_part(url, _SPLIT, 2))


def path(url: Column) -> Column:
    return _part(url, _SPLIT, 3)


def query(url: Column) -> Column:
    return _part(url, _SPLIT, 4)


def bare_path(url: Column) -> Column:
    """The path without closing slashes; ``/`` if nothing is left."""
    cut = F.regexp_replace(path(url), "/+$", "")
    return F.when(cut == "", "/").otherwise(cut)


def _values(query_: Column, key: str) -> Column:
    """``key=value`` items of a query, in order."""
    return F.filter(F.split(query_, "&"), lambda item: item.startswith(f"{key}="))


def canonical(url: Column | str) -> Column:
    """The one spelling under which a page is known."""
    raw = strip(url)
    name = F.when(host(raw).isin(*V.DIRECTIVE_HOSTS), V.DIRECTIVE_HOST).otherwise(host(raw))
    squeezed = F.regexp_replace(F.when(path(raw) == "", "/").otherwise(path(raw)), "/{2,}", "/")
    cut = F.when(squeezed == "/", squeezed).otherwise(F.regexp_replace(squeezed, "/+$", ""))
    cut = F.when((name == V.PORTAL_HOST) & cut.endswith("-0"), F.regexp_replace(cut, "-0$", "")).otherwise(cut)
    kept = F.array_join(F.flatten(F.array(*[_values(query(raw), k) for k in V.DIRECTIVE_KEYS])), "&")
    tail = F.when((name == V.DIRECTIVE_HOST) & (cut == V.DIRECTIVE_PATH) & (kept != ""), F.concat(F.lit("?"), kept)).otherwise("")
    return F.concat(F.when(scheme(raw) == "", "https").otherwise(scheme(raw)), F.lit("://"), name, cut, tail)


def _under(p: Column, root: str) -> Column:
    return p.startswith(root)


def _portal_page(p: Column, forms: bool) -> Column:
    found = (p == V.POLICY_PATH) | _under(p, V.GUIDE_PATH) | _under(p, V.REGULATIONS_PATH)
    return found | _under(p, V.FORMS_PATH) if forms else found


def in_scope(url: Column | str, *, forms: bool = False, directive_html: bool = False) -> Column:
    """Whether a page belongs to the corpus."""
    u = col(url)
    directive = host(u).isin(*V.DIRECTIVE_HOSTS) & (bare_path(u) == V.DIRECTIVE_PATH)
    wanted = F.coalesce(F.try_element_at(_values(query(u), "id"), F.lit(-1)) == f"id={V.DIRECTIVE_ID}", F.lit(False))
    if not directive_html:
        wanted = wanted & F.coalesce(F.try_element_at(_values(query(u), "section"), F.lit(-1)) == "section=xml", F.lit(False))
    return ((host(u) == V.PORTAL_HOST) & _portal_page(bare_path(u), forms)) | (directive & wanted)


def source_class(url: Column | str) -> Column:
    """(doc_type, authority_rank) of a page; paths count whatever the host, but for the directive."""
    u = col(url)
    p = bare_path(u)
    named = lambda kind, rank: F.struct(F.lit(kind).alias("doc_type"), F.lit(rank).alias("authority_rank"))
    return (
        F.when(host(u).isin(*V.DIRECTIVE_HOSTS) & (p == V.DIRECTIVE_PATH), named("tbs_directive", 1))
        .when((p == V.POLICY_PATH) | _under(p, V.REGULATIONS_PATH), named("buy_canadian_policy", 2))
        .when(_under(p, V.GUIDE_PATH), named("buyers_guide", 3))
        .when(_under(p, V.FORMS_PATH), named("forms_templates", 4))
        .otherwise(named("other", 9))
    )


def follow_links(url: Column | str, *, forms: bool = False) -> Column:
    """Whether a page's links are followed."""
    u = col(url)
    return (host(u) == V.PORTAL_HOST) & _portal_page(bare_path(u), forms)
