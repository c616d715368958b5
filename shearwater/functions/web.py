"""Phones, URLs, hosts, images and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, fold_digits

# fixed values
PREFECTURE_BY_HOST = (("kochi-apc.com", "高知県"), ("douai-tokushima.com", "徳島県"), ("kagawa", "香川県"), ("ehime", "愛媛県"))
PERSONAL_PREFIXES = ("070", "080", "090", "050")
NOT_IMAGES = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".csv", ".txt", ".zip", ".rtf")
JUNK_SEGMENTS = ("/common/", "/assets/", "/theme/", "/themes/", "/template", "/layout/", "/design/", "/parts/", "/share/", "/sns/")
JUNK_NAMES = (
    "logo", "icon", "ico_", "ico-", "nav", "btn", "button", "banner", "arrow", "bullet", "spacer", "blank", "dummy", "noimage", "no-image", "no_image",
    "placeholder", "header", "footer", "sns", "insta", "twitter", "facebook", "youtube",
)


def phone(c: Column) -> Column:
    """Hyphenated Japanese number of 10 or 11 digits, else empty."""
    s = F.translate(fold_digits(F.trim(c)), "－‐ー―−–—（）　()", "-------")
    s = F.trim(F.regexp_replace(s, r"(?is)(?<=.)(?:内線|ext|代表|／|/).*$", ""))
    digits = F.regexp_replace(s, "[^0-9]", "")
    n = F.length(digits)
    part = lambda a, k: F.substring(digits, a, k)
    kept = s.rlike("^0[0-9]*-[0-9]+-[0-9]+$") & n.isin(10, 11)
    return (
        F.when(~n.isin(10, 11) | c.isNull(), "").when(kept, s).when(n == 11, F.concat_ws("-", part(1, 3), part(4, 4), part(8, 4)))
        .when(digits.startswith("03") | digits.startswith("06"), F.concat_ws("-", part(1, 2), part(3, 4), part(7, 4)))
        .otherwise(F.concat_ws("-", part(1, 3), part(4, 3), part(7, 4)))
    )


def public_phone(c: Column) -> Column:
    """A personal number (mobile or IP) becomes null, like an empty one."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return blank_to_null(F.when((F.length(digits) == 11) & F.substring(digits, 1, 3).isin(*PERSONAL_PREFIXES), "").otherwise(c))


def found_phone(c: Column) -> Column:
    """X11: the first phone number in free text, hyphenated."""
    mobile, fixed, groups = "(0[5789]0)([0-9]{4})([0-9]{4})(?![0-9])", "(?<![0-9])(0[0-9]{2})([0-9]{3})([0-9]{4})(?![0-9])", "(0[0-9]{1,4})[- ]([0-9]{1,4})[- ]([0-9]{3,4})"
    by = lambda p: F.when(c.rlike(p), F.concat_ws("-", *(F.regexp_extract(c, p, i) for i in (1, 2, 3))))
    return F.coalesce(by(mobile), by(fixed), by(groups), F.lit(""))


def no_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def authority(url: Column) -> Column:
    """As written, with port."""
    return F.try_parse_url(no_fragment(url), F.lit("AUTHORITY"))


def host(url: Column) -> Column:
    """Lower case, without port."""
    return F.lower(F.try_parse_url(no_fragment(url), F.lit("HOST")))


def prefecture(url: Column) -> Column:
    """The first needle in the host decides."""
    h, out = host(url), None
    for needle, name in PREFECTURE_BY_HOST:
        out = (F if out is None else out).when(h.contains(needle), name)
    return out


def license_of(h: Column, deny: tuple[str, ...] = ()) -> Column:
    """N27."""
    public = h.rlike(r"\.lg\.jp$|\.go\.jp$|\.pref\.|\.city\.|\.metro\.")
    return F.when(h.isin(*deny) if deny else F.lit(False), "unknown").when(public, "gov_standard").otherwise("unknown")


def url_species(url: Column) -> Column:
    """By words of the URL's path."""
    u = F.lower(url)
    return F.when(u.rlike("/dog|/inu"), "犬").when(u.rlike("/cat|/neko"), "猫").otherwise("")


def images(urls: Column) -> Column:
    """http(s) only, each once in order, no other files; junk goes unless nothing else is left."""
    path = lambda u: F.regexp_replace(F.lower(u), "[?#].*$", "")
    name = lambda u: F.substring_index(path(u), "/", -1)
    real = F.array_distinct(F.filter(F.transform(urls, lambda u: F.trim(u)), lambda u: u.startswith("http://") | u.startswith("https://")))
    real = F.filter(real, lambda u: ~path(u).rlike("(?:" + "|".join(x.replace(".", r"\.") for x in NOT_IMAGES) + ")$"))
    junk = lambda u: name(u).endswith(".svg") | path(u).rlike("|".join(JUNK_SEGMENTS)) | name(u).rlike("|".join(JUNK_NAMES))
    good = F.filter(real, lambda u: ~junk(u))
    return F.when(F.size(good) > 0, good).otherwise(real)


def stored_path(hash_: Column, ext: str) -> Column:
    """Content-addressed file path."""
    return F.concat_ws("/", F.substring(hash_, 1, 2), F.substring(hash_, 3, 2), F.concat(hash_, F.lit("." + ext)))


def identity_key(first_image: Column) -> Column:
    """``img:`` host and path in lower case; none for placeholders."""
    plain = F.regexp_replace(F.lower(first_image), "[?#].*$", "")
    return F.when(first_image.isNotNull() & ~plain.rlike("noimage|no-image|no_image|placeholder|dummy"), F.concat(F.lit("img:"), F.regexp_replace(plain, "^https?://", "")))


def with_utm(url: Column, source: str) -> Column:
    """Appended unless there already."""
    mark = F.when(url.contains("?"), "&").otherwise("?")
    return F.when(url.contains("utm_source="), url).otherwise(F.concat(url, mark, F.lit(f"utm_source={source}")))
