"""URI parts by the generic RFC 3986 pattern, and the identity rules on them.

A regular expression is used instead of ``parse_url`` because the latter
rejects a URI with any unescaped character; the rules must still report on it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from attestra import fixed_values as fixed

_GENERIC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Plain forms that one match decides; whatever has another form goes by its parts.
_PLAIN_HTTPS = r"^https://[A-Za-z0-9.-]+(?:[/?#][\x21-\x7E]*)?\z"
_PLAIN_REFERENCE = r"^(?:urn:|https://[A-Za-z0-9.-]+(?=/|\z))[\x21\x22\x24-\x3E\x40-\x7E]*\z"


def scheme(uri: Column) -> Column:
    return F.lower(F.regexp_extract(uri, _GENERIC, 1))


def authority(uri: Column) -> Column:
    return F.regexp_extract(uri, _GENERIC, 2)


def path(uri: Column) -> Column:
    return F.regexp_extract(uri, _GENERIC, 3)


def query(uri: Column) -> Column:
    return F.regexp_extract(uri, _GENERIC, 4)


def fragment(uri: Column) -> Column:
    return F.regexp_extract(uri, _GENERIC, 5)


def has_userinfo(uri: Column) -> Column:
    return authority(uri).contains("@")


def host(uri: Column) -> Column:
    bare = F.regexp_replace(authority(uri), r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r":[0-9]*$", ""))


def has_port(uri: Column) -> Column:
    return authority(uri).rlike(r":[0-9]+$")


def _if_queried(uri: Column, names: Column) -> Column:
    """``names`` where the URI has a question mark; without one there is no query to read."""
    return F.when(uri.contains("?"), names).when(uri.isNotNull(), F.array().cast("array<string>"))


def query_names(uri: Column) -> Column:
    """Parameter names in order of appearance; an empty query has none."""
    pairs = F.filter(F.split(query(uri), "&"), lambda p: F.length(p) > 0)
    return _if_queried(uri, F.transform(pairs, lambda p: F.substring_index(p, "=", 1)))


def credential_names(uri: Column) -> Column:
    """Query parameters that carry a signature, token or expiry."""
    return _if_queried(uri, F.filter(
        F.transform(query_names(uri), lambda n: F.lower(n)),
        lambda n: n.isin(*fixed.CREDENTIAL_QUERY_NAMES) | n.startswith(fixed.CREDENTIAL_QUERY_PREFIX),
    ))


def signed_url_names(uri: Column) -> Column:
    return F.filter(
        F.transform(query_names(uri), lambda n: F.lower(n)), lambda n: n.isin(*fixed.SIGNED_URL_NAMES)
    )


def strip_query(uri: Column) -> Column:
    return F.regexp_replace(uri, r"[?#].*$", "")


def strip_queries_in_text(text: Column) -> Column:
    """Drop query and fragment of every https URL inside a message."""
    return F.regexp_replace(text, r"""(https://[^\s"'<>?#]+)[?#][^\s"'<>]*""", "$1")


def host_allowed(uri: Column, hosts: tuple[str, ...] | Column) -> Column:
    member = F.array_contains(hosts, host(uri)) if isinstance(hosts, Column) else host(uri).isin(*hosts)
    return (scheme(uri) == "https") & member & ~has_userinfo(uri)


def secure_address(uri: Column) -> Column:
    """An https URI that names a host."""
    return uri.rlike(_PLAIN_HTTPS) | ((scheme(uri) == "https") & (host(uri) != ""))


def stable_reference(reference: Column) -> Column:
    """An absolute https URI or URN without white space, query or fragment."""
    plain = ~reference.rlike(r"\s") & (F.length(reference) > 0)
    bare = (query(reference) == "") & (fragment(reference) == "")
    secure = (scheme(reference) == "urn") | (
        (scheme(reference) == "https") & ~has_userinfo(reference) & ~has_port(reference)
    )
    return F.coalesce(reference.rlike(_PLAIN_REFERENCE) | (plain & bare & secure), F.lit(False))


def identity_violation(
    uri: Column,
    *,
    required_scheme: str,
    hosts: tuple[str, ...],
    allowed_query: tuple[str, ...],
    path_rule: str,
    path_value: str,
    stable_identifier: str,
    project_id: Column | None = None,
) -> Column:
    """First identity rule a URI breaks, in rule order, or NULL."""
    names = query_names(uri)
    unexpected = F.size(F.filter(names, lambda n: ~n.isin(*allowed_query))) > 0 if allowed_query else F.size(names) > 0
    rule = F.lit(None).cast("string")
    project = project_id if project_id is not None else F.lit("")
    if path_rule == "EXACT":
        rule = F.when(path(uri) != path_value, F.lit("PATH_NOT_EXACT"))
    elif path_rule == "PROJECT_PATH":
        rule = F.when(path(uri) != F.concat(F.lit(path_value), project), F.lit("PATH_NOT_PROJECT"))
    elif path_rule == "PROJECT_TOKEN":
        words = F.split(path(uri), r"[^A-Za-z0-9]+")
        rule = F.when(
            ~(path(uri).startswith(path_value) & F.array_contains(words, project)), F.lit("PROJECT_TOKEN_MISSING")
        )
    stable = (
        F.lit(None).cast("string")
        if path_rule == "PROJECT_TOKEN"
        else F.when(~F.contains(F.lower(path(uri)), F.lit(stable_identifier.lower())), F.lit("STABLE_IDENTIFIER_MISSING"))
    )
    return F.coalesce(
        F.when(has_userinfo(uri), F.lit("USERINFO")),
        F.when(fragment(uri) != "", F.lit("FRAGMENT")),
        F.when(has_port(uri), F.lit("PORT")),
        F.when(scheme(uri) != required_scheme, F.lit("SCHEME")),
        F.when(~host(uri).isin(*hosts), F.lit("HOST")),
        F.when(F.size(credential_names(uri)) > 0, F.lit("CREDENTIAL_QUERY")),
        F.when(unexpected, F.lit("UNEXPECTED_QUERY")),
        rule,
        stable,
    )
