"""From identifiers to the files that hold them, by the rules of each corpus.

Every rule is an equality of two keys: an identifier asks for keys, each with its rule's place in the order (prio), and a
file offers keys. "Starts with" is one too: a file offers the beginnings of its name that are as long as some identifier
asks for. Offers are reduced to the best file of each key before they move, so a key that a million files offer reaches the
join as one row, and all such rules of a corpus share one join. "Contains" is a join by the rarest gram of what is asked
for (grams.py): a file offers as many grams as its name has letters.

Defined cases: a null or empty identifier, and one that no rule finds, gives a null path; identifiers that repeat are
answered once; of several files a rule's own order decides, then the smallest path, so answers don't depend on the order of
a walk; wildcards in identifiers stand for themselves; null paths are left out; other columns of both inputs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators import grams, rank, spread

#: The longest name of a file, so the longest part that can be asked for.
NAME = 255
#: A file without a usable number goes after those with one.
LAST = (1 << 32) - 1
# Suffixes of full names, and the beginnings of the files of each collection.
SUFFIXES = (".mul.xml", ".att.xml", ".tik.xml", ".nrf.xml")
COLLECTIONS = {"DN": "s01", "MN": "s02", "SN": "s03", "AN": "s04", "KN": "s05"}
# The last number of the first and of the second volume.
VOLUMES = {"DN": (13, 23), "MN": (50, 100)}
#: Names of lists of contents.
CONTENTS = "toc|sitemap|tree"


def _named(files: DataFrame) -> DataFrame:
    """path (relative to the corpus), name, stem, digits (at the stem's end), ext, folder (the first, null at the root), deep."""
    f = files.select("path").filter("path IS NOT NULL").withColumn("_at", F.split("path", "/"))
    f = f.select("path", F.element_at("_at", -1).alias("name"), (F.size("_at") - 1).alias("deep"), F.when(F.size("_at") > 1, F.col("_at")[0]).alias("folder"), F.when(F.size("_at") > 2, F.col("_at")[1]).alias("second"))
    f = f.withColumns({"stem": F.regexp_replace("name", r"(?<=.)\.[^.]*\z", ""), "ext": F.regexp_extract("name", r".\.([^.]*)\z", 1)})
    return f.withColumn("digits", F.regexp_extract("stem", r"([0-9]+)\z", 1))


def _number(digits: Column) -> Column:
    """Null for no digits, or too many. A cast that fails throws inside, which takes longer than all else of a row, so none is left to."""
    n = F.when(digits.rlike(r"\A[0-9]{1,18}\z"), digits.cast("bigint")).when(digits.rlike(r"\A[0-9]+\z"), digits.try_cast("bigint"))
    return F.when(n <= LAST, n)


class _Rules:
    """Asks and offers of one corpus, collected rule by rule: the rules' order is that of their asks."""

    def __init__(self):
        self.asks: list[Column] = []
        self.offers: list[tuple[int, Column, Column, Column, str | None]] = []
        self.kinds: dict[str, int] = {}

    def _code(self, kind: str) -> int:
        """Rows carry a number in place of a kind's name."""
        return self.kinds.setdefault(kind, len(self.kinds))

    def ask(self, kind: str, key: Column) -> None:
        """Null keys ask for nothing."""
        self.asks.append(F.struct(F.lit(len(self.asks)).alias("prio"), F.lit(self._code(kind)).alias("kind"), key.alias("key")))

    def offer(self, kind: str, key: Column, when: Column | None = None, order: Column | None = None, parts: str | None = None, scope: Column | None = None) -> None:
        """parts: every part of key ("any") or every beginning ("start") in place of key; scope is put before it."""
        key = key if when is None else F.when(when, key)
        self.offers.append((self._code(kind), key, F.lit(0) if order is None else order, F.lit("") if scope is None else scope, parts))

    def resolve(self, files: DataFrame, wanted: DataFrame) -> DataFrame:
        # a file of few bytes may hold all identifiers, and one task would tell them apart
        ids = spread.evenly(wanted.select("wanted_id")).distinct()
        # plain expressions, here and below, as functions of arrays are interpreted row by row; inline_outer, as a filter of the rows with some would compute them twice
        asks = ids.filter("wanted_id != ''").select("wanted_id", F.array(*self.asks).alias("_asks"))
        asked = asks.select("wanted_id", F.inline_outer("_asks")).filter("key IS NOT NULL")
        beginnings = {kind for kind, *_, p in self.offers if p == "start"}
        inside = {kind for kind, *_, p in self.offers if p == "any"}
        # lengths of names: at most NAME numbers for each kind
        rows = asked.filter(F.col("kind").isin(beginnings)).select("kind", F.length("key").alias("n")).filter(f"n BETWEEN 1 AND {NAME}").distinct().collect() if beginnings else []
        lengths = {k: sorted(r["n"] for r in rows if r["kind"] == k) for k in beginnings}
        named = _named(spread.evenly(files.select("path")))

        def offered(some: list) -> DataFrame:
            """One pass over the files makes the offers of some rules."""
            keys = [F.concat(scope, key) for _, key, _, scope, _ in some]
            made = named.select("path", *[k.alias(f"_key{i}") for i, k in enumerate(keys)], *[o[2].cast("long").alias(f"_order{i}") for i, o in enumerate(some)])
            each = [F.struct(F.lit(kind).alias("kind"), k.alias("key"), F.col(f"_order{i}").alias("order")) for i, (kind, *_, part) in enumerate(some) for k in (_beginnings(F.col(f"_key{i}"), lengths[kind]) if part == "start" else [F.col(f"_key{i}")])]
            return made.select("path", F.array(*each).alias("_offers")).select("path", F.inline_outer("_offers")).filter("key IS NOT NULL")

        best = F.min(F.struct("order", "path")).alias("best")
        equal = [o for o in self.offers if o[0] not in inside]
        # the key goes first, as sorts compare its first bytes at once
        hits = asked.join(grams.by_shuffle(offered(equal).groupBy("key", "kind").agg(best)), ["key", "kind"]).select("wanted_id", "prio", "best")
        if inside:
            hits = spread.kept(hits)
            scoped = lambda side: [F.concat(F.col("kind"), F.lit("\0"), F.when(F.contains("key", F.lit("\0")), F.split("key", "\0")[0]).otherwise(F.lit(""))).alias(f"{side}_scope"), F.element_at(F.split("key", "\0"), -1).alias(side)]
            # what an earlier rule has found isn't searched for
            known = hits.groupBy(F.col("wanted_id").alias("_id")).agg(F.min("prio").alias("_prio"))
            wanted_parts = asked.filter(F.col("kind").isin(inside)).join(grams.by_shuffle(known), F.col("wanted_id") == F.col("_id"), "left").filter("_prio IS NULL OR _prio > prio").select("wanted_id", "prio", *scoped("needle"))
            # names that are equal are searched once, for the best of their files
            names = offered([o for o in self.offers if o[0] in inside]).groupBy(*scoped("hay")).agg(best)
            # dealt, as the few bytes that are left for parts come together in one task, where their grams are many
            within = grams.containment(spread.kept(spread.evenly(wanted_parts)), "needle", spread.kept(names), "hay", ("needle_scope", "hay_scope"))
            hits = hits.unionByName(within.select("wanted_id", "prio", "best"))
        found = hits.groupBy(F.col("wanted_id").alias("_id")).agg(F.min(F.struct("prio", "best")).alias("found"))
        return ids.join(grams.by_shuffle(found), F.col("wanted_id") == F.col("_id"), "left").select("wanted_id", F.col("found.best.path").alias("path"))


def _beginnings(key: Column, lengths: list[int]) -> list[Column]:
    return [F.when(F.length(key) >= n, F.substring(key, 1, n)) for n in lengths]


def _xml(name: Column | None = None) -> Column:
    return (F.col("name") if name is None else name).endswith(".xml")


def _canonical() -> _Rules:
    """A canon's letters and a number: the canon's folder, a volume's folder and a name that ends in n and the number; then by
    any name of the canon's folder that holds n and the number; then any name that holds the identifier."""
    r, deep = _Rules(), F.col("deep")
    canon, number = F.regexp_extract(F.col("wanted_id"), r"\A([A-Za-z]+)([0-9]+)\z", 1), F.regexp_extract(F.col("wanted_id"), r"\A([A-Za-z]+)([0-9]+)\z", 2)
    is_one = F.col("wanted_id").rlike(r"\A[A-Za-z]+[0-9]+\z")
    r.ask("canon", F.when(is_one, F.concat(F.upper(canon), F.lit("/"), number)))
    r.ask("canon", F.when(is_one, F.concat(F.lower(canon), F.lit("/"), number)))
    r.ask("within", F.when(is_one, F.concat(canon, F.lit("\0n"), number)))
    r.ask("part", F.lower(F.col("wanted_id")))
    end = F.regexp_extract("name", r"n([0-9]+)\.xml\z", 1)
    room = F.length("name") >= F.length("folder") + F.length(end) + 5
    r.offer("canon", F.concat("folder", F.lit("/"), end), (deep == 2) & (end != "") & room & F.col("second").startswith(F.col("folder")) & F.col("name").startswith(F.col("folder")))
    low = F.lower(F.col("name"))
    r.offer("within", low, (deep > 0) & _xml(low), parts="any", scope=F.concat(F.coalesce("folder", F.lit("")), F.lit("\0")))
    r.offer("part", low, _xml(low), parts="any")
    return r


def _volume() -> tuple[Column, Column, Column]:
    """(beginning of the collection's files or null, the volume, whether a number is given) of identifiers such as DN1, SN 1.1, MN."""
    pattern = r"\A(DN|MN|SN|AN|KN)\s*([0-9]+)?(?:\.([0-9]+))?\z"
    up = F.upper(F.col("wanted_id"))
    collection, digits = F.regexp_extract(up, pattern, 1), F.regexp_extract(up, pattern, 2)
    n = F.coalesce(_number(digits), F.when(digits != "", F.lit(1)))
    volume = F.lit("01")
    for name, (one, two) in VOLUMES.items():
        volume = F.when(collection == name, F.when(n > two, "03").when(n > one, "02").otherwise("01")).otherwise(volume)
    begins = F.lit(None).cast("string")
    for name, start in COLLECTIONS.items():
        begins = F.when(collection == name, start).otherwise(begins)
    return begins, volume, digits != ""


def _pali() -> _Rules:
    """The file itself, with a suffix, a collection's volume, any name that starts so (texts before commentaries); then by stem,
    by the least number after it, by what contains it (lists of contents left out), and by the name in any case."""
    r, at_root = _Rules(), F.col("deep") == 0
    begins, volume, numbered = _volume()
    for suffix in (".xml", *SUFFIXES):
        r.ask("path", F.concat(F.col("wanted_id"), F.lit(suffix)))
    r.ask("path", F.concat(begins, volume, F.lit("m.mul.xml")))
    r.ask("volume", F.when(numbered, F.concat(begins, volume)).otherwise(begins))
    r.ask("collection", begins)
    r.ask("start", F.lower(F.col("wanted_id")))
    r.ask("stem", F.col("wanted_id"))
    r.ask("next", F.col("wanted_id"))
    r.ask("base", F.lower(F.col("wanted_id")))
    r.ask("within", F.lower(F.col("wanted_id")))
    r.ask("name", F.lower(F.concat(F.col("wanted_id"), F.lit(".xml"))))
    r.offer("path", F.col("path"))
    text = at_root & F.col("name").endswith("m.mul.xml")
    r.offer("volume", F.substring("name", 1, 5), text & (F.length("name") >= 14))
    r.offer("volume", F.substring("name", 1, 3), text & (F.length("name") >= 12))
    r.offer("collection", F.substring("name", 1, 3), at_root & _xml() & (F.length("name") >= 7))
    listed = F.lower(F.col("name")).rlike(CONTENTS)
    r.offer("start", F.regexp_replace("name", r"\.xml\z", ""), at_root & _xml() & ~F.col("name").rlike(CONTENTS), F.when(F.col("path").contains(".mul."), 0).otherwise(1), parts="start")
    r.offer("stem", F.col("stem"))
    # a stem that ends in digits follows each of its beginnings that leaves digits only
    for cut in range(1, 11):
        tail = F.when(F.length("digits") >= cut, F.right(F.col("digits"), F.lit(cut)).cast("bigint"))
        r.offer("next", F.expr(f"left(stem, length(stem) - {cut})"), tail <= LAST, tail)
    rank_ = F.coalesce(_number(F.regexp_extract(F.regexp_replace(F.lower("name"), r"(\.xml)+\z", ""), r"([0-9]+)\z", 1)), F.lit(LAST))
    r.offer("base", F.lower("name"), (F.col("ext") == "xml") & ~listed, rank_, parts="any")
    r.offer("within", F.lower("stem"), F.col("ext") == "xml", parts="any")
    r.offer("name", F.lower("name"))
    return r


def _sanskrit() -> _Rules:
    """The file itself, with the corpus's prefix, what starts so (commentaries and other versions last), what holds it after the
    prefix; then by stem and by what contains it."""
    r, at_root = _Rules(), F.col("deep") == 0
    prefixed = F.when(F.col("wanted_id").startswith("sa_"), F.col("wanted_id")).otherwise(F.concat(F.lit("sa_"), F.col("wanted_id")))
    r.ask("path", F.concat(F.col("wanted_id"), F.lit(".xml")))
    r.ask("path", F.concat(prefixed, F.lit(".xml")))
    r.ask("start", prefixed)
    r.ask("after", F.lower(F.col("wanted_id")))
    r.ask("stem", F.col("wanted_id"))
    r.ask("within", F.lower(F.col("wanted_id")))
    r.offer("path", F.col("path"))
    bare = F.regexp_replace("name", r"\.xml\z", "")
    r.offer("start", bare, at_root & _xml(), F.when(F.col("name").rlike("-comm|-alt"), 1).otherwise(0), parts="start")
    r.offer("after", F.substring(bare, 4, NAME), at_root & _xml() & F.col("name").startswith("sa_"), parts="any")
    r.offer("stem", F.col("stem"))
    r.offer("within", F.lower("stem"), parts="any")
    return r


def _plain_name() -> Column:
    """The identifier, unless it could leave the corpus."""
    return F.when(~F.col("wanted_id").contains("/") & ~F.col("wanted_id").contains("\\"), F.col("wanted_id"))


def _sarit() -> _Rules:
    """The file at the root or among the transliterated; then by stem, by what contains it, by the name in any case."""
    r = _Rules()
    name = F.when(F.col("wanted_id").endswith(".xml"), _plain_name()).otherwise(F.concat(_plain_name(), F.lit(".xml")))
    r.ask("path", name)
    r.ask("path", F.concat(F.lit("transliterated/"), name))
    r.ask("stem", F.col("wanted_id"))
    r.ask("within", F.lower(F.col("wanted_id")))
    r.ask("name", F.lower(F.concat(F.col("wanted_id"), F.lit(".xml"))))
    r.offer("path", F.col("path"))
    r.offer("stem", F.col("stem"))
    r.offer("within", F.lower("stem"), F.col("ext") == "xml", parts="any")
    r.offer("name", F.lower("name"))
    return r


def _muktabodha() -> _Rules:
    """The file as named, as .xml, as .txt; then by stem, and by the name and the stem in any case."""
    r = _Rules()
    r.ask("path", _plain_name())
    for kind in (".xml", ".txt"):
        r.ask("path", F.concat(_plain_name(), F.lit(kind)))
    r.ask("stem", F.col("wanted_id"))
    for kind in (".xml", ".txt"):
        r.ask("name", F.lower(F.concat(F.col("wanted_id"), F.lit(kind))))
    r.ask("low", F.lower(F.col("wanted_id")))
    r.offer("path", F.col("path"))
    r.offer("stem", F.col("stem"))
    r.offer("name", F.lower("name"))
    r.offer("low", F.lower("stem"), F.col("ext").isin("xml", "txt"))
    return r


RULES = {"cbeta": _canonical, "tipitaka": _pali, "gretil": _sanskrit, "sarit": _sarit, "muktabodha": _muktabodha}


def resolve(files: DataFrame, wanted: DataFrame, corpus: str) -> DataFrame:
    """wanted (wanted_id) with the path of files (path, relative to the corpus) that the corpus's rules find; null if none."""
    return RULES[corpus]().resolve(files, wanted)


def one(files: DataFrame, catalogue: DataFrame, corpus: str, identifier: str | None = None, query: str | None = None) -> DataFrame:
    """The path (one row, or none) of an identifier or, only where none is given, of the title nearest to a query.

    catalogue: path, id and the stored normal forms hay_norm and hay_ws.
    """
    if identifier is not None:
        wanted = files.sparkSession.createDataFrame([(identifier,)], "wanted_id string")
        return resolve(files, wanted, corpus).select("path").filter("path IS NOT NULL")
    if query is None:
        return catalogue.select("path").limit(0)
    return rank.title_search(catalogue, query, 1).select("path")
