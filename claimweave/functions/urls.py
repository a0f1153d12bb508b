"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters whose names begin so say where a visitor came from (fixed values).
TRACKING = ("utm_", "gclid", "fbclid", "mc_", "_ga", "ref", "aff", "affiliate")
#: Source tiers by domain, in order of precedence: the first entry that a host is or ends with counts (fixed values).
TIERS = (
    ("samsung.com", 1),
    ("apple.com", 1),
    ("selfservicerepair.com", 1),
    ("google.com", 1),
    ("motorola.com", 1),
    ("mi.com", 1),
    ("xiaomi.com", 1),
    ("consumer.huawei.com", 1),
    ("huawei.com", 1),
    ("oppo.com", 1),
    ("vivo.com", 1),
    ("oneplus.com", 1),
    ("realme.com", 1),
    ("nokia.com", 1),
    ("sony.com", 1),
    ("lg.com", 1),
    ("nothing.tech", 1),
    ("asus.com", 1),
    ("lenevo.com", 1),
    ("lenovo.com", 1),
    ("fairphone.com", 1),
    ("tecno-mobile.com", 1),
    ("infinixmobility.com", 1),
    ("itel-mobile.com", 1),
    ("honor.com", 1),
    ("htc.com", 1),
    ("blackberry.com", 1),
    ("micromaxinfo.com", 1),
    ("lava.in", 1),
    ("ifixit.com", 2),
    ("samsungparts.com", 2),
    ("parts4gsm.com", 2),
    ("mobilesentrix.com", 2),
    ("injuredgadgets.com", 2),
    ("gsmarena.com", 2),
    ("phonearena.com", 2),
    ("kimovil.com", 2),
    ("devicespecifications.com", 2),
    ("gsmchoice.com", 2),
    ("manualslib.com", 2),
    ("manualzz.com", 2),
    ("scribd.com", 4),
    ("reddit.com", 4),
    ("xda-developers.com", 4),
    ("xdaforums.com", 4),
    ("gsmhosting.com", 4),
    ("gsm-forum.com", 4),
    ("repair.wiki", 4),
    ("ebay.com", 3),
    ("amazon.com", 3),
    ("aliexpress.com", 3),
    ("alibaba.com", 3),
    ("walmart.com", 3),
    ("temu.com", 3),
    ("wish.com", 3),
    ("etsy.com", 3),
    ("flipkart.com", 3),
    ("lazada.com", 3),
    ("shopee.com", 3),
    ("daraz.pk", 3),
    ("jumia.com.ng", 3),
    ("konga.com", 3),
    ("quora.com", 4),
    ("youtube.com", 4),
    ("facebook.com", 4),
    ("pinterest.com", 4),
    ("tiktok.com", 4),
)
#: Parts of a host that tell the tier where the domain is unknown, in order (fixed values).
HINTS = ((2, r"(^|\.)(support|docs|manuals?)\."), (4, "forum|community|reddit|board"), (3, "marketplace|shop|store|buy|deal"), (2, "parts|repair|gsm|fix|mobile"))
OTHER_TIER = 4
AUTHORITY = {1: 1.0, 2: 0.8, 3: 0.5, 4: 0.35}


def domain_of(url: Column) -> Column:
    """Host in lower case without ``www.``; empty if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """https, lower-case host without ``www.``, no fragment, tracking parameters or slash at the end, parameters sorted."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    tracked = r"^(?i:" + "|".join(TRACKING) + ")"
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(tracked))), "&")
    path = F.regexp_replace(rest, "/+$", "")
    return F.when(domain_of(url) != "", F.concat(F.lit("https://"), domain_of(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def domain_tier(host: Column) -> Column:
    """Tier 1 to 4: by the first known domain that the host is or ends with, else by a hint, else 4."""
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(tier).alias("tier")) for name, tier in TIERS])
    fits = F.filter(known, lambda k: (host == k["name"]) | host.endswith(F.concat(F.lit("."), k["name"])))
    out = F.lit(OTHER_TIER)
    for tier, hint in reversed(HINTS):
        out = F.when(host.rlike(hint), F.lit(tier)).otherwise(out)
    return F.coalesce(F.get(fits, F.lit(0))["tier"], out)


def authority(tier: Column) -> Column:
    out = None
    for t, a in AUTHORITY.items():
        out = F.when(tier == t, F.lit(a)) if out is None else out.when(tier == t, F.lit(a))
    return out


def site_name(domain: Column) -> Column:
    """A name for a site: the label before the last two of its host, or the first of two, with a capital."""
    labels = F.split(domain, r"\.")
    core = F.when(F.size(labels) > 2, F.get(labels, F.size(labels) - 3)).otherwise(F.get(labels, F.lit(0)))
    return F.when(F.coalesce(domain, F.lit("")) == "", "unknown source").otherwise(F.concat(F.upper(F.substring(core, 1, 1)), F.substring(core, 2, 253)))


def ipv4_number(host: Column) -> Column:
    """Dotted address as a long; null for anything else."""
    parts = F.transform(F.split(host, r"\."), lambda p: p.cast("long"))
    valid = host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    return F.when(valid, F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p))


#: Ranges of IPv4 addresses that are not public, as (network, bits) (fixed values).
PRIVATE = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def is_private_ipv4(host: Column) -> Column:
    n, out = ipv4_number(host), F.lit(False)
    for network, bits in PRIVATE:
        low = sum(int(p) << (24 - 8 * k) for k, p in enumerate(network.split(".")))
        out = out | n.between(low, low + (1 << (32 - bits)) - 1)
    return F.coalesce(out, F.lit(False))


#: Beginnings of IPv6 addresses that are not public: local links, local networks, multicast, documentation, NAT64 (fixed values).
PRIVATE_V6 = ("fe80", "fc", "fd", "ff", "2001:db8", "64:ff9b")


def is_ipv6(host: Column) -> Column:
    """Eight groups of hexadecimal digits, or fewer around one ``::``; the last two may be a dotted IPv4 address."""
    groups = F.regexp_replace(F.lower(host), r"(?<=:)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$", "0:0")
    run = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
    n = F.size(F.filter(F.split(groups, ":"), lambda g: g != ""))
    return F.coalesce((groups.rlike(f"^{run}$") & (n == 8)) | (groups.rlike(f"^(?:{run})?::(?:{run})?$") & (n <= 7)), F.lit(False))


def is_public_ip(host: Column) -> Column:
    """An address of either kind that is public; false for anything else. Mapped IPv4 addresses count as what they map."""
    low = F.lower(host)
    mapped = F.regexp_extract(low, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    v4 = F.when(mapped != "", mapped).otherwise(host)
    local = low.isin("::", "::1")
    for start in PRIVATE_V6:
        local = local | low.startswith(start)
    return F.coalesce(F.when(ipv4_number(v4).isNotNull(), ~is_private_ipv4(v4)).otherwise(is_ipv6(host) & ~local), F.lit(False))


def url_fault(url: Column) -> Column:
    """Why an address must not be fetched: protocol, credentials, host or private; null if nothing speaks against it."""
    host = domain_of(url)
    address = F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?\[([^\]]*)\]", 1), F.lit(""))
    internal = r"^localhost$|\.(?:local|internal|localhost|lan|home|corp)$"
    return (
        F.when(~F.coalesce(url, F.lit("")).rlike(r"^(?i:https?)://"), F.lit("protocol"))
        .when(url.rlike(r"^[A-Za-z]+://[^/?#]*@"), F.lit("credentials"))
        .when(address.isNotNull() & ~is_public_ip(address), F.lit("private"))
        .when((host == "") | host.rlike(internal) | host.rlike(r"^\d+$|^0x"), F.lit("host"))
        .when(is_private_ipv4(host), F.lit("private"))
    )
