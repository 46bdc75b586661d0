"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of links that are not followed.
SKIPPED_ENDINGS = [".jpg", ".jpeg", ".gif", ".png", ".txt"]
PARTS = r"^([^/]+?):?//([^/:]*)(?::([^/]*))?(/.*)?$"


def part(url: Column, group: int) -> Column:
    """A group of PARTS, null where it is missing."""
    found = F.regexp_extract(url, PARTS, group)
    return F.when(found != "", found)


def has_host(url: Column) -> Column:
    return url.rlike(r"^[^/]+//") & url.rlike(PARTS)


def parse(url: Column) -> Column:
    """Struct of protocol, host, port and path. Without ``//`` all is path; a missing
    path after a host is ``/``."""
    whole = has_host(url)
    return F.struct(
        F.when(whole, part(url, 1)).alias("protocol"),
        F.when(whole, part(url, 2)).alias("host"),
        F.when(whole, part(url, 3)).alias("port"),
        F.when(whole, F.coalesce(part(url, 4), F.lit("/"))).otherwise(url).alias("path"),
    )


def default_port(protocol: Column) -> Column:
    return F.when(protocol == "https", "443").otherwise("80")


def normalize(url: Column) -> Column:
    """The URL with its port spelt out."""
    p = parse(url)
    return F.concat(p["protocol"], F.lit("://"), p["host"], F.lit(":"), F.coalesce(p["port"], default_port(p["protocol"])), p["path"])


def ignored_protocol(url: Column) -> Column:
    """Whether there is a protocol other than http and https."""
    protocol = parse(url)["protocol"]
    return protocol.isNotNull() & ~protocol.isin("http", "https")


def collapse_dots(path: Column) -> Column:
    """A path with its ``..`` resolved; null if they lead above the root."""
    zero = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("ok"))

    def step(a: Column, x: Column) -> Column:
        up, empty = x == "..", F.size(a["kept"]) == 0
        shorter = F.slice(a["kept"], F.lit(1), F.greatest(F.size(a["kept"]) - 1, F.lit(0)))
        return F.struct(F.when(up, shorter).otherwise(F.concat(a["kept"], F.array(x))).alias("kept"), (a["ok"] & ~(up & empty)).alias("ok"))

    return F.aggregate(F.array_remove(F.split(path, "/"), ""), zero, step, lambda a: F.when(a["ok"], F.concat(F.lit("/"), F.array_join(a["kept"], "/"))))


def resolve(link: Column, base: Column) -> Column:
    """The absolute URL of a link on a page; null for one that is not followed.

    The fragment goes; pictures and text files are skipped; an empty link is the page
    itself; only http and https are followed; the port is spelt out; ``..`` is resolved.
    """
    bare = F.regexp_replace(link, "#.*$", "")
    own, page = parse(bare), parse(base)
    skipped = F.lit(False)
    for ending in SKIPPED_ENDINGS:
        skipped = skipped | bare.endswith(ending)
    protocol = F.coalesce(own["protocol"], page["protocol"])
    host = F.coalesce(own["host"], page["host"])
    port = F.coalesce(own["port"], default_port(protocol))
    folder = F.regexp_extract(page["path"], "^(.*/)", 1)
    path = F.when(own["path"].startswith("/"), own["path"]).otherwise(collapse_dots(F.concat(folder, own["path"])))
    rooted = F.concat(page["protocol"], F.lit("://"), page["host"], F.lit(":"), default_port(page["protocol"]), bare)
    return (
        F.when(skipped, None)
        .when(bare == "", base)
        .when(bare.startswith("/"), rooted)
        .when(protocol.isin("http", "https"), F.concat(protocol, F.lit("://"), host, F.lit(":"), port, path))
    )


def join_path(source: Column, target: Column) -> Column:
    """A relative path joined to a page's path; leading ``.`` and ``..`` are resolved,
    and more ``..`` than folders stay at the root."""
    bare = F.regexp_replace(target, "#.*$", "")
    folders = F.array_remove(F.split(source, "/"), "")
    folders = F.when(source.endswith("/"), folders).otherwise(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - 1, F.lit(0))))
    steps = F.array_remove(F.split(bare, "/"), "")
    zero = F.struct(F.lit(0).alias("up"), F.lit(0).alias("skip"), F.lit(True).alias("lead"))

    def step(a: Column, x: Column) -> Column:
        dots = a["lead"] & x.isin(".", "..")
        return F.struct(F.when(dots & (x == ".."), a["up"] + 1).otherwise(a["up"]).alias("up"), F.when(dots, a["skip"] + 1).otherwise(a["skip"]).alias("skip"), dots.alias("lead"))

    lead = F.aggregate(steps, zero, step)
    kept = F.slice(folders, F.lit(1), F.greatest(F.size(folders) - lead["up"], F.lit(0)))
    rest = F.slice(steps, lead["skip"] + 1, F.greatest(F.size(steps) - lead["skip"], F.lit(0)))
    dotted = F.concat(F.lit("/"), F.array_join(F.concat(F.transform(kept, lambda x: F.concat(x, F.lit("/"))), F.array(F.array_join(rest, "/"))), ""))
    return F.when(bare == "", source).when(bare.startswith("/"), bare).when(bare.startswith("."), dotted).otherwise(F.concat(F.regexp_extract(source, "^(.*/)", 1), bare))


def links(html: Column) -> Column:
    """The quoted ``href`` values of a page's ``a`` tags, in order."""
    return F.regexp_extract_all(html, F.lit(r'<[aA]\s[^>]*?href="([^"]*)"'), F.lit(1))


def robots_verdict(robots: Column, path: Column, agent: str) -> Column:
    """Struct of allowed and delay_s for a path under a robots file.

    Lines of sections for the agent or ``*`` are taken in order, without spaces and in
    lower case; the first allow or disallow that the path begins with decides, and
    none allows. The last crawl-delay before that decides the delay; 10 ms without one.
    """
    pairs = F.transform(F.split(robots, "\n"), lambda x: F.split(F.regexp_replace(F.lower(x), r" |[: ]+$", ""), ":"))
    pairs = F.filter(pairs, lambda x: F.size(x) == 2)
    zero = F.struct(F.lit(False).alias("own"), F.lit(None).cast("boolean").alias("verdict"), F.lit(0.01).alias("delay"))

    def step(a: Column, x: Column) -> Column:
        agent_line, live = x[0] == "user-agent", a["own"] & a["verdict"].isNull()
        hit = live & path.startswith(x[1])
        return F.struct(
            F.when(agent_line, x[1].isin(agent.lower(), "*")).otherwise(a["own"]).alias("own"),
            F.when(hit & (x[0] == "allow"), True).when(hit & (x[0] == "disallow"), False).otherwise(a["verdict"]).alias("verdict"),
            F.coalesce(F.when(live & (x[0] == "crawl-delay"), x[1].try_cast("double")), a["delay"]).alias("delay"),
        )

    return F.aggregate(pairs, zero, step, lambda a: F.struct(F.coalesce(a["verdict"], F.lit(True)).alias("allowed"), a["delay"].alias("delay_s")))
