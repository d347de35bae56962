"""Host names, site rules and policies, as Columns that Catalyst can push down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that are never recorded, labels that mark a host as private, suffixes that are no public site.
BLOCKED_HOSTS = (
    "mail.google.com", "outlook.live.com", "outlook.office.com", "proton.me", "mail.yahoo.com", "web.whatsapp.com", "messenger.com",
    "web.telegram.org", "pornhub.com", "xvideos.com", "paypal.com", "chase.com", "mychart.com", "accounts.google.com", "login.microsoftonline.com",
)
BLOCKED_LABELS = ("banking", "webmail", "login", "accounts", "patient", "auth")
RESERVED_SUFFIXES = ("localhost", "local", "internal", "test", "invalid", "onion")

HOSTNAME = r"^([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]*[a-z0-9])?$"
IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def site_matches(site: Column | str, rule: Column | str) -> Column:
    """The site is the rule or a subdomain of it (dot boundary)."""
    site, rule = _col(site), _col(rule)
    return (site == rule) | F.endswith(site, F.concat(F.lit("."), rule))


def matches_any(site: Column | str, rules: tuple[str, ...] | list[str]) -> Column:
    """As site_matches, for rules known when the plan is made: a disjunction of literals that reaches the scan."""
    site = _col(site)
    return reduce(lambda a, b: a | b, [(site == r) | site.endswith(f".{r}") for r in rules], F.lit(False))


def matches_array(site: Column | str, rules: Column | str) -> Column:
    """As site_matches, for an array column of rules; null is no rule."""
    return F.coalesce(F.exists(_col(rules), lambda r: site_matches(site, r)), F.lit(False))


def valid_site(site: Column | str) -> Column:
    site = _col(site)
    return (F.length(site) <= 253) & site.rlike(HOSTNAME) & ~site.rlike(IPV4) & ~matches_any(site, RESERVED_SUFFIXES)


def blocked_site(site: Column | str) -> Column:
    site = _col(site)
    return matches_any(site, BLOCKED_HOSTS) | F.arrays_overlap(F.split(site, r"\."), F.array(*[F.lit(x) for x in BLOCKED_LABELS]))


def site_policy(site: Column | str, excluded: list[str], selected_only: bool = False, selected: list[str] | None = None) -> Column:
    """Not excluded and, with selected_only, selected; selected_only without a selection admits nothing."""
    out = ~matches_any(site, excluded)
    return out & matches_any(site, selected or []) if selected_only else out


def policy_allows(site: Column | str, prefix: str = "") -> Column:
    """The same for policy columns that are joined to the row."""
    p = lambda c: F.col(prefix + c)
    return ~matches_array(site, p("excluded_sites")) & (~p("selected_only") | matches_array(site, p("selected_sites")))


def suffixes(site: Column | str) -> Column:
    """A host and all its parents, for equi-joins with rules: a.b.c gives a.b.c, b.c, c."""
    parts = F.split(_col(site), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
