"""Variant spellings of names: join of the parts within two edits, a check of each pair by name parts, average linkage.

1. Every name is folded and parsed into a form; equal forms are one item however many rows share them.
2. All pairs of distinct parts that variants spell alike (surname, place or program name) within the edits that the check allows are found exactly: two
   words within so many edits or swaps are led to one word by leaving out at most as many letters of each. (similar_keys, an n-gram cosine join, is an
   alternative that loses pairs: typing errors make rare n-grams, which weigh most.)
3. A pair of forms with such parts is weighed by all parts of the names (kinds of unit, given name, initials).
4. Pairs above the threshold span components, which average linkage cuts into groups.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidex.llm.groups import connected_components
from evidex.session import keep_only, scratch_dir, written

# Titles and ranks, without points.
TITLES = set("mr mrs miss ms dr prof lt lieut lieutenant col colonel cdr comdr commander capt captain maj major sgt sergeant cpl corporal gen general adm admiral pvt private insp inspector".split())
# Given names with usual short forms.
GIVEN = {
    "alexander": "alex alec al sandy", "anthony": "tony ant", "charles": "charlie chuck chas", "constance": "connie con", "daniel": "dan danny",
    "dorothy": "dot dolly dottie dora", "edward": "ed eddie ted ned", "eleanor": "nell ellie nora ella", "elizabeth": "liz beth betty eliza lizzie libby bess",
    "frances": "fran frankie fanny", "francis": "frank", "gerald": "gerry jerry", "harold": "hal harry", "henry": "hank harry hal", "ignatius": "iggy nate",
    "james": "jim jimmy jamie", "john": "jack johnny", "katherine": "kate kathy kitty katie kay", "catherine": "cathy kate", "lawrence": "larry laurie",
    "leonard": "len lenny leo", "margaret": "maggie meg peggy madge marge greta", "michael": "mike mick mickey", "nathaniel": "nat nate", "oscar": "oz ozzie",
    "patricia": "pat patty tricia trish", "philip": "phil pip", "quentin": "quent quin", "richard": "dick rick rich", "robert": "bob rob bobby robbie bert",
    "stanley": "stan", "susan": "sue susie", "theodore": "theo ted teddy", "thomas": "tom tommy", "ursula": "ulla ursie", "victoria": "vicky vic tori",
    "walter": "walt wally", "william": "bill will billy willie liam", "yvonne": "eve vonnie", "zachary": "zach zack zak", "george": "georgie", "joseph": "joe",
    "samuel": "sam", "benjamin": "ben", "andrew": "andy drew", "matthew": "matt", "christopher": "chris kit", "rebecca": "becky", "deborah": "debbie",
}
# Short forms of words in unit, place and program names.
UNIT_WORDS = {"sqn": "squadron", "sq": "squadron", "wg": "wing", "gp": "group", "bn": "battalion", "det": "detachment", "regt": "regiment", "rgt": "regiment", "flt": "flight", "ofc": "office", "off": "office", "recon": "reconnaissance", "comm": "communications", "intel": "intelligence", "log": "logistics", "tac": "tactical", "wx": "weather", "ftr": "fighter", "rdr": "radar", "ptl": "patrol", "surv": "survey", "div": "division", "bde": "brigade", "coy": "company"}
PLACE_WORDS = {"mt": "mount", "st": "saint", "ste": "saint", "ft": "fort", "pt": "point", "l": "lake", "is": "island", "hbr": "harbor", "cp": "camp", "r": "river"}
PLACE_KINDS = set("mount saint fort point lake island harbor camp river cape bay port".split())
PROGRAM_WORDS = set("project proj operation op program programme study the".split())
NICK = defaultdict(set)
for _full, _short in GIVEN.items():
    NICK[_full].add(_full)
    for _s in _short.split():
        NICK[_s].add(_full)


def fold(s: str) -> str:
    """Lower case without accents."""
    if s.isascii():
        return s.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def osa(a: str, b: str, most: int = 2) -> int:
    """Edits with swaps of neighbours (optimal string alignment), or most + 1 beyond most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def _words(s: str) -> list[str]:
    """Letters and digits in runs; digits inside a word are read as letters."""
    return [w if w.isdigit() or re.fullmatch(r"\d+(st|nd|rd|th|d)", w) else w.translate(str.maketrans("0153", "olse")) for w in re.findall(r"[a-z0-9]+", fold(s).replace("'", ""))]


@lru_cache(maxsize=100_000)
def given_fulls(w: str) -> frozenset[str]:
    """Full given names that a word may stand for, typos included; empty for other words."""
    if w in NICK:
        return frozenset(NICK[w])
    if len(w) >= 5:
        return frozenset(g for g in GIVEN if osa(w, g, 1) <= 1)
    return frozenset()


def parse_person(name: str) -> tuple[str, str, str, str]:
    """(surname, given, middle initial, rank); given may be an initial or empty."""
    head, _, tail = name.partition(",")
    a, b = _words(head), _words(tail)
    title = " ".join(w for w in a + b if w in TITLES)
    a, b = [w for w in a if w not in TITLES], [w for w in b if w not in TITLES]
    if b and a:  # Surname, Given M.
        return "".join(a), b[0], b[1][0] if len(b) > 1 else "", title
    a = a or b
    if not a:
        return "", "", "", title
    if len(a) == 1:
        return a[0], "", "", title
    last = max((i for i, w in enumerate(a) if len(w) > 1), default=len(a) - 1)
    # Surname first, without a comma: what follows is a given name or an initial, and the first word is none
    if len(a[0]) > 1 and not given_fulls(a[0]) and given_fulls(a[1]):
        return a[0], a[1], a[2][0] if len(a) > 2 else "", title
    if last == 0:
        return a[0], a[1], a[2][0] if len(a) > 2 else "", title
    rest = a[:last]
    return a[last], rest[0], rest[1][0] if len(rest) > 1 else "", title


def parse_form(kind: str, name: str) -> str:
    """The form of a name as text, its parts separated by '|'; equal forms mean the same."""
    if kind == "person":
        return "|".join(parse_person(name))
    words = _words(name)
    if kind == "unit":
        nums = [re.sub(r"\D", "", w).lstrip("0") for w in words if w[0].isdigit()]
        if re.fullmatch(r"\s*\d+\s+[A-Z]{2}\s*", name):  # a number and initials
            return "|".join((nums[0], name.split()[1].lower()))
        rest = [UNIT_WORDS.get(w, w) for w in words if not w[0].isdigit() and w not in ("the", "no", "number")]
        return "|".join((" ".join(nums), " ".join(sorted(rest))))
    if kind == "location":
        ws = [PLACE_WORDS.get(w, w) for w in words if w != "the"]
        return "|".join((" ".join(sorted(w for w in ws if w in PLACE_KINDS)), "".join(w for w in ws if w not in PLACE_KINDS)))
    if kind == "program":
        head, _, tail = name.partition(",")
        words = _words(tail) + _words(head) if tail else words
        return "|".join(("", "".join(w for w in words if w not in PROGRAM_WORDS)))
    return "|".join(("", "".join(words)))


def key_part(kind: str, form: str) -> str:
    """The part of a form that variants spell alike but for typing errors: surname, unit number, place or program name."""
    p = form.split("|")
    return p[0] if kind in ("person", "unit") else p[-1]


def first_letters(kind: str, form: str) -> list[str]:
    """First letters that the given name of a person may have in full; one empty letter for other kinds."""
    if kind != "person":
        return [""]
    g = form.split("|")[1]
    return sorted({g[:1]} | {x[0] for x in given_fulls(g)})


def grams(kind: str, key: str) -> list[str]:
    """Character trigrams of a padded name; of a number (units, aircraft) the whole, because numbers have no variants."""
    if kind in ("unit", "aircraft"):
        return [f"#{key}"]
    s = f"_{key}_"
    return sorted({s[i : i + 3] for i in range(max(1, len(s) - 2))})


def _given_score(a: str, b: str) -> float:
    if not a or not b:
        return 0.7
    if a == b:
        return 1.0 if len(a) > 1 else 0.9
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return 0.8 if b[0] == a or any(g[0] == a for g in NICK.get(b, ())) else 0.0
    fa, fb = given_fulls(a), given_fulls(b)
    if fa & fb:
        return 0.97
    if len(a) <= 4 and any(g.startswith(a) for g in fb | {b}):
        return 0.93
    return 0.93 if osa(a, b, 2) <= (1 if len(a) < 7 else 2) else 0.0


# By kind, the length from which a name may differ by two edits; a shorter one by one. Other kinds have no variants of the part.
TWO_EDITS = {"person": 7, "location": 7, "program": 9}


def allowed_edits(kind: str, a: str, b: str) -> int:
    """The most edits or swaps by which the parts of two names of one kind may differ."""
    return 0 if kind not in TWO_EDITS else 2 if min(len(a), len(b)) >= TWO_EDITS[kind] else 1


def left_out(kind: str, key: str) -> list[str]:
    """key without up to as many letters as it may have edits: two keys within their allowed edits have one of these in common."""
    out = level = {key}
    for _ in range(allowed_edits(kind, key, key)):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return sorted(out)


def pair_score(kind: str, a: str, b: str, about_a: str | None = None, about_b: str | None = None) -> float:
    """How surely two forms of a kind name the same: 0 to about 1."""
    x, y = a.split("|"), b.split("|")
    if kind == "person":
        if not x[0] or not y[0]:
            return 0.0
        d = osa(x[0], y[0], 2)
        if d > allowed_edits(kind, x[0], y[0]):
            return 0.0
        g = _given_score(x[1], y[1])
        m = (1.0 if x[2] == y[2] else 0.0) if x[2] and y[2] else 0.88 if x[2] or y[2] else 0.94
        o = 1.0
        if about_a and about_b:
            o = 1.05 if about_a.split(",")[0] == about_b.split(",")[0] else 0.0
        return (1.0, 0.95, 0.88)[d] * g * m * o
    if kind == "unit":
        if x[0] != y[0] or not x[0]:
            return 0.0
        wa, wb = x[1].split(), y[1].split()
        if len(wa) > len(wb):
            wa, wb = wb, wa
        if not wa:
            return 0.7
        if len(wa) == 1 and len(wa[0]) == len(wb) and len(wb) > 1:  # initials; reconnaissance is R or N
            initials = sorted({w[0] for w in wb})
            fit = sum(c in initials or (c == "n" and "reconnaissance"[:1] in initials) for c in wa[0])
            return 0.9 * fit / len(wb)
        left, total = list(wb), 0.0
        for w in wa:
            best = min(left, key=lambda v: osa(w, v, 3), default="")
            if best and osa(w, best, 3) <= 2:
                left.remove(best)
                total += 1
            elif best and (hit := next((v for v in left if v.startswith(w[:3])), "")):
                left.remove(hit)
                total += 0.8
        return total / max(len(wa), len(wb))
    if kind == "location":
        if x[0] != y[0] and x[0] and y[0]:
            return 0.0
        d = osa(x[1], y[1], 2)
        return (1.0, 0.92, 0.82)[d] * (1 if x[0] == y[0] else 0.8) if d <= allowed_edits(kind, x[1], y[1]) else 0.0
    if kind == "program":
        d = osa(x[1], y[1], 2)
        return (1.0, 0.92, 0.82)[d] if d <= allowed_edits(kind, x[1], y[1]) else 0.0
    return 1.0 if a == b else 0.0


def average_linkage(edges: list[tuple[int, int, float]], threshold: float) -> dict[int, int]:
    """Group of every node: the pair of groups with the highest mean similarity is merged until none reaches the threshold.

    Pairs without an edge have similarity 0. Ties are broken by the smaller node numbers.
    """
    sim: dict[int, dict[int, float]] = defaultdict(dict)
    size: dict[int, int] = {}
    for a, b, s in edges:
        size[a] = size[b] = 1
        if a != b:
            sim[a][b] = sim[b][a] = s
    parent = {n: n for n in size}
    heap = [(-s, min(a, b), max(a, b)) for a, b, s in edges if a != b]
    heapq.heapify(heap)
    while heap:
        s, a, b = heapq.heappop(heap)
        if a not in size or b not in size or sim[a].get(b) is None or abs(sim[a][b] / (size[a] * size[b]) + s) > 1e-12:
            continue
        if -s < threshold:
            break
        for c, v in sim.pop(b).items():
            del sim[c][b]
            if c != a:
                sim[a][c] = sim[c][a] = sim[a].get(c, 0.0) + v
        size[a] += size.pop(b)
        parent[b] = a
        for c, v in sim[a].items():
            heapq.heappush(heap, (-v / (size[a] * size[c]), min(a, c), max(a, c)))
    out = {}
    for n in parent:
        r = n
        while parent[r] != r:
            r = parent[r]
        out[n] = r
    return out


def linkage_rounds(edges: DataFrame, threshold: float) -> DataFrame:
    """(fid, g): average_linkage() over edges (a, b, s), a < b, without gathering a component: what of any size is cut with.

    In each round every group finds its best neighbour by mean similarity, and pairs that are each other's best merge, all at once. Average
    linkage allows that: a merged group is never nearer to a third than the nearer of its two parts. g is the smallest
    name of a group; of equal similarities the smaller names come first.
    """
    spark = edges.sparkSession
    root = scratch_dir(spark)
    sums = written(edges.filter("a <> b").select("a", "b", F.col("s").alias("t"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")), f"{root}/s0")
    label = written(edges.select(F.explode(F.array("a", "b")).alias("fid")).distinct().select("fid", F.col("fid").alias("g")), f"{root}/l0")
    k = 0
    while True:
        both = sums.select("a", "b", (F.col("t") / (F.col("na") * F.col("nb"))).alias("m")).filter(F.col("m") >= threshold)
        ends = both.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "m"), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), "m"))).alias("e")).select("e.*")
        best = ends.groupBy("x").agg(F.min_by("y", F.struct(-F.col("m"), F.least("x", "y"), F.greatest("x", "y"))).alias("y"))
        pairs = best.join(best.select(F.col("x").alias("y"), F.col("y").alias("x")), ["x", "y"]).filter("x < y").select(F.col("y").alias("old"), F.col("x").alias("new"))
        pairs = written(pairs, f"{root}/p{k}")
        if pairs.isEmpty():
            keep_only(spark, root, f"l{k}")
            return label
        k += 1
        to = lambda c: F.coalesce(F.col(f"new_{c}"), F.col(c))
        p = lambda c: pairs.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}"))
        label = written(label.join(p("g"), "g", "left").select("fid", to("g").alias("g")), f"{root}/l{k}")
        size = label.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        moved = sums.join(p("a"), "a", "left").join(p("b"), "b", "left").select(to("a").alias("a"), to("b").alias("b"), "t").filter("a <> b")
        moved = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("t").alias("t"))
        n = lambda c: size.select(F.col("g").alias(c), F.col("n").alias(f"n{c}"))
        sums = written(moved.join(n("a"), "a").join(n("b"), "b").select("a", "b", "t", "na", "nb"), f"{root}/s{k}")


def linked_groups(inside: DataFrame, threshold: float, most_edges: int = 200_000) -> DataFrame:
    """(fid, g): average linkage of every component of inside (component, a, b, s): one with at most most_edges edges in one task, a larger one by rounds over the cluster."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        no = {n: i for i, n in enumerate(names)}
        groups = average_linkage(sorted((no[a], no[b], s) for a, b, s in zip(pdf["a"], pdf["b"], pdf["s"], strict=True)), threshold)
        return pd.DataFrame({"fid": names, "g": [names[groups[i]] for i in range(len(names))]})

    giant = inside.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_edges).select("component")
    tasks = max(inside.sparkSession.sparkContext.defaultParallelism, 2)
    small = inside.join(giant, "component", "left_anti").repartition(2 * tasks, "component").groupBy("component").applyInPandas(link, "fid string, g string")
    large = inside.join(giant, "component", "left_semi")
    return small if large.isEmpty() else small.unionByName(linkage_rounds(large.select("a", "b", "s"), threshold))


def similar_keys(keys: DataFrame, min_cosine: float) -> DataFrame:
    """(kind, a, b), a < b: keys (columns kind, key, grams) whose n-gram vectors have a cosine of at least min_cosine.

    A gram weighs the root of its inverse document frequency. Keys that differ in length by more than two, or by more
    than four letters put in, left out or changed, are left out: two edits or swaps, the most that a later check allows,
    can't bridge that.
    """
    g = keys.select("kind", "key", F.explode("grams").alias("gram"))
    totals = keys.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    df = g.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(totals), "kind")  # totals: one row a kind
    w = g.join(df.select("kind", "gram", F.log1p(F.col("n") / F.col("df")).alias("w2")), ["kind", "gram"])
    # unit length; rest: squared weight of a gram and of all more frequent ones
    e = F.reverse(F.array_sort(F.collect_list(F.struct("w2", "gram"))))  # as many entries as a name has grams
    vec = w.groupBy("kind", "key").agg(e.alias("e"), F.sum("w2").alias("total"))
    vec = vec.withColumn("weights", F.map_from_entries(F.transform("e", lambda x: F.struct(x["gram"], F.sqrt(x["w2"] / F.col("total"))))))
    rest = lambda x, i: F.aggregate(F.slice(F.col("e"), i + 1, F.size("e")), F.lit(0.0), lambda s, y: s + y["w2"]) / F.col("total")
    indexed = F.transform(F.filter(F.transform("e", lambda x, i: F.struct(x["gram"].alias("gram"), rest(x, i).alias("rest"))), lambda x: x["rest"] >= min_cosine * min_cosine - 1e-9), lambda x: x["gram"])
    index = vec.select("kind", F.explode(indexed).alias("gram"), "key")
    x, y = index.select("kind", "gram", F.col("key").alias("a")), index.select("kind", "gram", F.col("key").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 2) & (F.levenshtein("a", "b", 4) >= 0)
    pairs = x.join(y, ["kind", "gram"]).filter(near).select("kind", "a", "b").distinct()
    va, vb = (vec.select("kind", F.col("key").alias(k), F.col("weights").alias(f"v{k}")) for k in "ab")
    both = pairs.join(va, ["kind", "a"]).join(vb, ["kind", "b"])
    dot = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("vb", e["key"]), F.lit(0.0)))
    return both.filter(dot >= min_cosine).select("kind", "a", "b")


def near_keys(keys: DataFrame) -> DataFrame:
    """(kind, a, b), a < b: all pairs of keys (columns kind, key) within the edits that pair_score allows."""

    @F.pandas_udf("array<string>")
    def cut(kinds: pd.Series, ks: pd.Series) -> pd.Series:
        return pd.Series([left_out(k, x) for k, x in zip(kinds, ks, strict=True)], dtype=object)

    @F.pandas_udf("boolean")
    def close(kinds: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([osa(x, y, 2) <= allowed_edits(k, x, y) for k, x, y in zip(kinds, a, b, strict=True)], dtype=bool)

    k = keys.filter(F.col("kind").isin(*TWO_EDITS)).select("kind", "key", F.explode(cut("kind", "key")).alias("w")).select("kind", "key", F.xxhash64("w").alias("w"))
    pairs = k.select("kind", "w", F.col("key").alias("a")).join(k.select("kind", "w", F.col("key").alias("b")), ["kind", "w"]).filter("a < b")
    return pairs.select("kind", "a", "b").distinct().filter(close("kind", "a", "b"))


def name_groups(df: DataFrame, key: str, kind: str, name: str, about: str | None = None, threshold: float = 0.62) -> DataFrame:
    """(key, kind, group) for every row of df whose name and kind are not null; group is the smallest key of its group.

    about: an optional column whose text before a comma rules out pairs that differ in it. Defined results: rows with a
    null or blank name, or a null kind or key, are left out; a name without letters or digits is its own group; rows with
    the same form and note are in one group whatever their number; repeated rows give one row; the result does not depend
    on order or partitioning; other columns are ignored; an empty table gives an empty table.
    """
    spark = df.sparkSession
    root = scratch_dir(spark)

    @F.pandas_udf("string")
    def form(kinds: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([parse_form(k.strip().lower(), n) for k, n in zip(kinds, names, strict=True)], dtype=object)

    @F.pandas_udf("struct<k:string,letters:array<string>>")
    def parts(kinds: pd.Series, forms: pd.Series) -> pd.DataFrame:
        keys = [key_part(k, f) for k, f in zip(kinds, forms, strict=True)]
        return pd.DataFrame({"k": keys, "letters": [first_letters(k, f) for k, f in zip(kinds, forms, strict=True)]})

    note = F.lower(F.trim(F.split(F.col(about), ",")[0])) if about else F.lit(None).cast("string")
    rows = df.select(F.col(key).alias("key"), F.lower(F.trim(F.col(kind))).alias("kind"), F.col(name).alias("name"), note.alias("note"))
    rows = rows.filter("key is not null and kind is not null and trim(name) <> ''").select("key", "kind", form("kind", "name").alias("form"), F.coalesce("note", F.lit("")).alias("note"))
    fid = F.md5(F.concat_ws("\u0001", "kind", "form", "note"))
    rows = written(rows.withColumn("fid", fid).distinct(), f"{root}/rows")
    forms = rows.select("fid", "kind", "form", "note").distinct().withColumn("p", parts("kind", "form"))
    forms = written(forms.select("fid", "kind", "form", "note", "p.*"), f"{root}/forms")
    keys = forms.select("kind", F.col("k").alias("key")).filter("key <> ''").distinct()
    near = written(near_keys(keys), f"{root}/near")
    same = keys.select("kind", F.col("key").alias("a"), F.col("key").alias("b"))
    near = near.unionByName(near.select("kind", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same)

    @F.pandas_udf("double")
    def score(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for k, a, b, na, nb in it:
            yield pd.Series([pair_score(*x) for x in zip(k, a, b, na, nb, strict=True)], dtype=float)

    side = lambda x: forms.select("kind", F.col("k").alias(x), F.explode("letters").alias("letter"), *(F.col(c).alias(f"{c}_{x}") for c in ("fid", "form", "note")))
    pairs = side("a").join(near, ["kind", "a"]).join(side("b"), ["kind", "b", "letter"]).filter("fid_a < fid_b").drop("letter", "a", "b").distinct()
    edges = pairs.select(F.col("fid_a").alias("a"), F.col("fid_b").alias("b"), score("kind", "form_a", "form_b", "note_a", "note_b").alias("s"))
    edges = written(edges.filter(F.col("s") >= 0.5 * threshold), f"{root}/edges")
    comp = connected_components(edges.filter(F.col("s") >= threshold).select(F.col("a").alias("u"), F.col("b").alias("v")))
    comp = written(comp, f"{root}/comp")
    ca = comp.select(F.col("node").alias("a"), "component")
    cb = comp.select(F.col("node").alias("b"), F.col("component").alias("component_b"))
    inside = edges.join(ca, "a").join(cb, "b").filter("component = component_b").select("component", "a", "b", "s")
    inside = written(inside, f"{root}/inside")
    linked = linked_groups(inside, threshold)
    labelled = written(rows.join(linked, "fid", "left").select("key", "kind", F.coalesce("g", "fid").alias("g")), f"{root}/labelled")
    keep_only(spark, root, "labelled")
    least = labelled.groupBy("kind", "g").agg(F.min("key").alias("group"))
    return labelled.join(least, ["kind", "g"]).select("key", "kind", "group").distinct()


def pairs_of_groups(groups: DataFrame) -> DataFrame:
    """All pairs (id_a, id_b), id_a < id_b, of keys of one group: the result itself, for callers that ask for every pair."""
    a, b = groups.select("group", F.col("key").alias("id_a")), groups.select("group", F.col("key").alias("id_b"))
    return a.join(b, "group").filter("id_a < id_b").select("id_a", "id_b").distinct()
