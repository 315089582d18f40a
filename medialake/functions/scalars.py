"""Scalar Column builders: times, counts, dates, ids and URLs."""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import Column

# Hosts of the video platform and the shapes of its ids.
HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be", "www.youtube-nocookie.com"]
VIDEO_ID = r"^[A-Za-z0-9_-]{11}$"
CHANNEL_ID = r"^UC[A-Za-z0-9_-]{22}$"
HANDLE = r"^@[\w.-]{1,50}$"
LANGUAGE_TAG = r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$"
# What stands before the id in a link to a video.
LINKS = ["youtube.com/watch?v=", "youtu.be/", "youtube.com/embed/", "youtube.com/v/", "youtube.com/shorts/"]

# Typed codes of a video's availability and live status.
AVAILABILITY_CODES = {"private": "PRIVATE", "subscriber_only": "MEMBERS_ONLY", "premium_only": "PREMIUM_ONLY", "needs_auth": "AGE_GATED"}
LIVE_CODES = {"is_upcoming": "LIVE_NOT_ENDED", "post_live": "LIVE_NOT_ENDED"}

# What an extractor's error text holds, in the order in which rules are tried.
FAILURE_RULES = [
    ("Sign in to confirm you", "BOT_CHECK"),
    ("HTTP Error 429", "RATE_LIMITED"),
    ("This channel does not have a", "NOT_FOUND"),
    ("There are no subtitles for the requested languages", "NO_CAPTIONS"),
    ("but ffmpeg is not installed", "FFMPEG_MISSING"),
    ("ffmpeg not found. Please install or provide the path using --ffmpeg-location", "FFMPEG_MISSING"),
    ("for tips on effectively exporting YouTube cookies", "LOGIN_REQUIRED"),
]
# Fixed value: the code of any other error text.
FAILURE_FALLBACK = "YTDLP_FAILED"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_timestamp(seconds: Column | str) -> Column:
    """``H:MM:SS`` or ``M:SS`` of whole seconds; negatives count as 0."""
    total = F.floor(F.greatest(_col(seconds), F.lit(0))).cast("long")
    hours, minutes, rest = F.floor(total / 3600).cast("long"), F.floor(total % 3600 / 60).cast("long"), total % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))


def format_duration(seconds: Column | str) -> Column:
    """As ``format_timestamp``, but parts of a second are shown and nothing is clamped."""
    total = _col(seconds).cast("double")
    hours, minutes = F.floor(total / 3600).cast("long"), F.floor(total % 3600 / 60).cast("long")
    shown = F.regexp_replace((total % 60).cast("string"), r"\.0$", "")
    rest = F.when(F.length(shown) < 2, F.concat(F.lit("0"), shown)).otherwise(shown)
    return F.when(hours > 0, F.concat(F.format_string("%d:%02d:", hours, minutes), rest)).otherwise(F.concat(F.format_string("%d:", minutes), rest))


def subtitle_timestamp(seconds: Column | str, separator: str = ",") -> Column:
    """``HH:MM:SS,mmm``; negatives count as 0, and the milliseconds come from the whole time, so they stay below 1000."""
    millis = F.floor(F.greatest(_col(seconds), F.lit(0)) * 1000 + 0.5).cast("long")
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", F.floor(millis / 3600000).cast("long"), F.floor(millis / 60000).cast("long") % 60, F.floor(millis / 1000).cast("long") % 60, millis % 1000)


def watch_url(video_id: Column | str) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), _col(video_id))


def deep_link(video_id: Column | str, seconds: Column | str) -> Column:
    at = F.floor(F.greatest(_col(seconds), F.lit(0))).cast("long").cast("string")
    return F.concat(watch_url(video_id), F.lit("&t="), at, F.lit("s"))


def parse_timestamp(text: Column | str) -> Column:
    """Seconds of ``90``, ``1:30`` or ``01:02:03.5``; null for anything else. With a colon, minutes and seconds are
    below 60 and have two digits at most."""
    parts = F.split(F.trim(_col(text)), ":")
    n, part = F.size(parts), lambda k: F.try_element_at(parts, F.lit(k))
    plain = (n == 1) & part(1).rlike(r"^\d+(\.\d+)?$")
    timed = n.isin(2, 3) & part(-1).rlike(r"^[0-5]?\d(\.\d+)?$") & part(-2).rlike(r"^[0-5]?\d$") & ((n == 2) | part(1).rlike(r"^\d+$"))
    hours = F.when(n == 3, part(1).cast("double")).otherwise(0.0)
    return F.when(plain, part(1).cast("double")).when(timed, hours * 3600 + part(-2).cast("double") * 60 + part(-1).cast("double"))


def upload_date(text: Column | str) -> Column:
    """A date of either spelling, ``YYYYMMDD`` or ``YYYY-MM-DD``; null if it is neither."""
    digits = F.regexp_replace(_col(text), "-", "")
    return F.when(digits.rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd"))))


def to_fixed(x: Column, decimals: int) -> Column:
    """A number that is not negative, with so many decimals: the nearest to the double's exact value, of two the larger.

    The double is split into halves whose products with the power of ten are exact, so the rounding is too."""
    x, scale = x.cast("double"), float(10**decimals)
    wide = x * 134217729.0  # 2 ** 27 + 1
    high = wide - (wide - x)
    near = F.floor(x * scale + 0.5)
    over = lambda half: (high * scale - (near + half)) + (x - high) * scale
    n = F.when(over(-0.5) < 0, near - 1).when(over(0.5) >= 0, near + 1).otherwise(near).cast("long")
    return F.format_string(f"%d.%0{decimals}d", F.floor(n / int(scale)).cast("long"), n % int(scale))


def format_count(n: Column | str) -> Column:
    """``999``, ``1.5K``, ``2M``, ``3.1B``."""
    n = _col(n)
    short = lambda unit, sign: F.concat(F.regexp_replace(to_fixed(n / F.lit(float(unit)), 1), r"\.0$", ""), F.lit(sign))
    return F.when(n >= 10**9, short(10**9, "B")).when(n >= 10**6, short(10**6, "M")).when(n >= 1000, short(1000, "K")).otherwise(n.cast("string"))


def format_filesize(n: Column | str, slack: float = 0.0) -> Column:
    """KB and MB with one decimal, GB with two; ``Unknown`` for 0 or nothing. ``slack`` is added to the number that is
    rounded, for tables whose sizes just below a tie are to go up."""
    n = F.coalesce(_col(n), F.lit(0))
    size = lambda unit, decimals, sign: F.concat(to_fixed(n / F.lit(float(unit)) + slack, decimals), F.lit(f" {sign}"))
    return F.when(n == 0, "Unknown").when(n < 2**20, size(2**10, 1, "KB")).when(n < 2**30, size(2**20, 1, "MB")).otherwise(size(2**30, 2, "GB"))


def round_millis(seconds: Column | str) -> Column:
    return F.floor(_col(seconds) * 1000 + 0.5) / 1000


def video_id(url: Column | str) -> Column:
    """The id after the first of ``LINKS`` in a URL, or the text itself if it is an id; null otherwise."""
    url = _col(url)
    watch, shorts = ("|".join(re.escape(x) for x in own) for own in (LINKS[:-1], LINKS[-1:]))
    after = [F.nullif(F.regexp_extract(url, rf"(?:{links})([a-zA-Z0-9_-]{{11}})", 1), F.lit("")) for links in (watch, shorts)]
    return F.when(url.rlike(VIDEO_ID), url).otherwise(F.coalesce(*after))


def allowed_url(url: Column | str, hosts: list[str] = HOSTS) -> Column:
    """The URL in https if its host is allowed and it has neither credentials nor a port; null otherwise.

    A URL without a scheme is taken for one if it starts with an allowed host."""
    url = F.trim(_col(url))
    bare = "|".join(h.replace(".", r"\.") for h in hosts)
    full = F.when(url.rlike(f"(?i)^(?:{bare})/"), F.concat(F.lit("https://"), url)).otherwise(url)
    host = F.lower(F.regexp_extract(full, r"(?i)^https?://([^/?#:@]+)(?:[/?#]|$)", 1))
    return F.when(host.isin(hosts), F.regexp_replace(full, "(?i)^https?://", "https://"))


def list_target(reference: Column | str) -> Column:
    """The URL of a channel or playlist named by a URL, a handle or a channel id."""
    text = F.trim(_col(reference))
    site = F.lit("https://www.youtube.com/")
    return F.when(text.rlike(HANDLE), F.concat(site, text)).when(text.rlike(CHANNEL_ID), F.concat(site, F.lit("channel/"), text)).when(text.rlike("[/.]"), allowed_url(text))


def channel_url(channel: Column | str) -> Column:
    """As ``list_target``, but a bare name counts as a handle."""
    text = F.trim(_col(channel))
    named = F.concat(F.lit("https://www.youtube.com/"), F.when(text.startswith("@"), text).otherwise(F.concat(F.lit("@"), text)))
    return F.when(text.contains("/"), allowed_url(text)).otherwise(named)


def channel_key(text: Column | str) -> Column:
    """A channel alias in the form in which aliases are compared."""
    return F.regexp_replace(F.lower(F.trim(_col(text))), "/+$", "")


def safe_stem(title: Column | str, fallback: Column | str) -> Column:
    """A file name's stem: no control, separator or reserved characters, no leading dots, 80 characters at most."""
    text = F.regexp_replace(_col(title), "(?U)\\s+", " ")
    text = F.regexp_replace(text, r"\p{C}", "")
    text = F.regexp_replace(text, r'[/\\?%*:|"<>]', "")
    text = F.trim(F.substring(F.trim(F.regexp_replace(text, r"^\.+", "")), 1, 80))
    return F.coalesce(F.nullif(text, F.lit("")), _col(fallback))


def merge_tags(old: Column | str, add: Column | str) -> Column:
    """The tags with those to add behind them, each once, in the order in which they came."""
    return F.array_union(F.coalesce(_col(old), F.array().cast("array<string>")), _col(add))


def remove_tags(old: Column | str, remove: list[str]) -> Column:
    gone = [t.lower() for t in remove]
    return F.filter(_col(old), lambda t: ~F.lower(t).isin(gone)) if gone else _col(old)


def hash_prefix(text: Column | str, digits: int = 4) -> Column:
    return F.substring(F.sha2(_col(text).cast("binary"), 256), 1, digits)


def playability(availability: Column | str, live_status: Column | str) -> Column:
    """The typed code of why a video cannot be read; null if it can."""
    out = F.lit(None).cast("string")
    for value, code in reversed(LIVE_CODES.items()):
        out = F.when(_col(live_status) == value, code).otherwise(out)
    for value, code in reversed(AVAILABILITY_CODES.items()):
        out = F.when(_col(availability) == value, code).otherwise(out)
    return out


def failure_code(error_text: Column | str) -> Column:
    """The typed code of an extractor's error text: the first rule that it holds."""
    low, out = F.lower(_col(error_text)), F.lit(FAILURE_FALLBACK)
    for part, code in reversed(FAILURE_RULES):
        out = F.when(low.contains(part.lower()), code).otherwise(out)
    return out


def version_age_days(version: Column | str, today: Column) -> Column:
    """Days since a version named ``YYYY.MM.DD``; null for other names."""
    day = F.regexp_extract(_col(version), r"^(\d{4})\.(\d{2})\.(\d{2})", 0)
    return F.datediff(today, F.to_date(F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("yyyy.MM.dd"))))


def midpoints(begin: Column, end: Column, n: int) -> Column:
    """The middles of ``n`` equal parts of an interval."""
    step = (end - begin) / n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: begin + step * (i + F.lit(0.5)))


def clamp_range(begin: Column, end: Column, duration: Column) -> Column:
    """``start, end`` within a known duration; null if the range is empty or starts past the end."""
    known = duration > 0
    bad = (end <= begin) | (known & (begin >= duration))
    return F.when(~bad, F.struct(begin.alias("start"), F.when(known, F.least(end, duration)).otherwise(end).alias("end")))


def scan_window(begin: Column, end: Column, most: float = 900.0) -> Column:
    """A window for a scan of at most ``most`` seconds; null if it is empty or longer."""
    return F.when((end > begin) & (end - begin <= most), F.struct(begin.alias("start"), end.alias("end")))


def distinct_times(times: Column | str) -> Column:
    return F.array_sort(F.array_distinct(_col(times)))
