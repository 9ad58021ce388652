"""Link variant spellings of names of persons, organisations and groups.

1. Names are brought to tokens: accents, case, punctuation, titles, particles and bracketed acronyms go; names with equal tokens are one form.
2. A symmetric-delete index finds tokens a small edit apart: tokens meet on equal strings left after deleting up to two
   characters (one below seven), and are then checked by edit distance.
3. Two forms match by the best assignment of their tokens: equal, a small edit, a nickname, an abbreviation, an initial, or an acronym of neighbouring
   tokens. Every word of both names must be matched, at least one of them whole (equal, a small edit or a nickname); middle initials may stay over on one side.
4. Candidates are complete: each way in which the whole word can match is a key that both forms hold (the token, of two neighbours the more frequent one, each
   nickname base). Where more than ``HOT`` forms hold a key, it is refined by the ways in which the rarest other token of one form can match any token of
   the other, as it must: whole, by its initial, as an abbreviation or as an acronym. Whether a key is refined depends on the key alone, so both forms agree and no pair is lost.
5. Matches without initials and acronyms are links; actors are their connected components. A form with an initial or
   acronym joins an actor only if all it matches is one actor; otherwise it is ambiguous and joins none.

Defined cases: null and empty names, and names of fewer than two tokens, are linked to nothing; a text of more
than ``MAX_TOKENS`` words is no name and links only where its form is equal; repeated rows count once; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.components import connected_components
from quillstone.operators.pairs import pairs_across, pairs_within
from quillstone.session import cut, fence

HOT, MAX_TOKENS = 30, 32
# Titles, particles and common forms of given names.
TITLES = frozenset("dr mr mrs ms miss sir gen general col colonel capt captain cmdr commander maj major lt lieutenant sgt sergeant judge justice prof professor hon rev fr sheikh imam president minister".split())
PARTICLES = frozenset("the of and for de la le al el von van".split())
NICKNAMES = {
    "alexander": "alex sasha sandro aleksandar aleksander aleksandr alexandre alejandro xander", "anthony": "tony antony antonio anton antoine toni", "abdullah": "abdallah abdulla abdalla",
    "benjamin": "ben benny", "charles": "charlie chuck carlos karl", "christopher": "chris kit kristofer kristopher cristobal", "daniel": "dan danny dani danilo", "david": "dave davy",
    "dimitri": "dmitry dima dmitri dimitrij dimitar mitya", "edward": "ed eddie ted ned", "eduardo": "edu lalo eduard edward eddie", "elizabeth": "beth liz lizzie eliza betty elisabeth libby elisabet", "emina": "emma amina mina",
    "fatima": "fatma fatimah", "francisco": "paco pancho francis frank franjo francesco cisco", "frederick": "fred freddie fredrick frederic friedrich fritz rick", "gabriel": "gabe gabi gavriel jibril", "george": "jorge djordje georg",
    "guadalupe": "lupe lupita", "hussein": "husayn hussain husein hossein hoseyn", "ibrahim": "abraham ibro", "isabella": "bella isabel izabela isabelle izzy", "james": "jim jimmy jaime", "johannes": "hans hannes johann john jan johan ivan jens",
    "john": "jack johnny jon jan ivan juan", "jonathan": "jon jonny", "joseph": "joe josef jozef yusuf josip jose yousef", "jovan": "jovo jova ivan jovica", "katherine": "kate kathy katie catherine kathryn katarina cathy kat catalina",
    "khadija": "khadidja hatidza hatice khadijah", "ljiljana": "lilly lily ljilja liljana lilyana", "margaret": "maggie meg peg peggy marge margarita greta margareta", "matthew": "matt mateo", "michael": "mike mick mikael mikhail mihail miguel mihajlo michel misha mikey",
    "muhammad": "mohammed mohamed mohammad muhammed mehmed mehmet mohamad", "mustafa": "mustapha mujo", "nicholas": "nick nikola nicolas nikolas nico nikolai nicola nicky", "osman": "othman uthman usman", "patricia": "pat trish patty tricia patrizia patrice",
    "quentin": "quint quinton quintin", "rebecca": "becky becca rebeka rebekah", "richard": "rick dick rich ricardo", "robert": "bob rob bobby roberto robbie bert", "samuel": "sam sammy samuil", "stephen": "steve steven stefan stevan esteban",
    "stjepan": "stipe stevan stefan stephen stjepo", "theodore": "ted theo teddy teodor theodor fyodor", "thomas": "tom tommy tomas toma", "ulrich": "uli ulli ulric", "victoria": "vicky vicki tori viktoria vika", "vladimir": "volodymyr vlado vlad vladimer vova wladimir",
    "wilhelm": "willi willy helmut vilhelm wilhem", "william": "bill will billy willy liam guillermo willie", "yusuf": "yousuf yousef youssef jusuf yosef iusuf", "zeynep": "zainab zaynab zejneba zaineb zeinab",
}
GIVEN: dict[str, frozenset[str]] = {}
for _name, _forms in NICKNAMES.items():
    for _form in (_name, *_forms.split()):
        GIVEN[_form] = GIVEN.get(_form, frozenset()) | {_name}


def tokens(name: str) -> list[str]:
    s = "".join(c for c in unicodedata.normalize("NFKD", name.replace("ß", "ss").replace("đ", "d").replace("Đ", "D").replace("ł", "l").replace("ø", "o").replace("ı", "i")) if not unicodedata.combining(c))
    s = re.sub(r"\(\s*[A-Z.]{2,8}\s*\)", " ", s)
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", re.sub(r"['’`]", "", s)).lower()
    s = re.sub(r"\bco-op\b", "coop", s)
    s = re.sub(r"\b(?:[a-z]\.){2,}", lambda m: m.group().replace(".", "") + " ", s)
    found = re.findall(r"[^\W_]+", s)
    core = [t for t in found if t not in PARTICLES and t not in TITLES]
    return core if len(core) >= 2 else found


@lru_cache(100_000)
def distance(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours."""
    if abs(len(a) - len(b)) > 2:
        return 3
    two, one, row = [], list(range(len(b) + 1)), []
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return row[-1] if row else len(b)


def close(a: str, b: str) -> bool:
    short, long = sorted((len(a), len(b)))
    return short >= 4 and distance(a, b) <= (2 if long >= 8 and short >= 7 else 1)


@lru_cache(200_000)
def affinity(a: str, b: str) -> tuple[float, bool]:
    """Worth of matching two tokens, 0 if they don't match, and whether the match is only an initial."""
    if a == b:
        return 1.0, False
    ga, gb = GIVEN.get(a), GIVEN.get(b)
    if ga and gb:
        return (0.95, False) if ga & gb else (0.0, False)
    if close(a, b):
        return 0.9, False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) == 1:
        starts = {long[0], *(x[0] for x in GIVEN.get(long, ()))}
        return (0.5, True) if short in starts and len(long) > 1 else (0.0, False)
    if short[0] == long[0] and len(short) <= 0.7 * len(long) and len(short) <= 6:
        rest = iter(long)
        if all(c in rest for c in short):
            return 0.6, False
    return 0.0, False


def _assign_few(worth: list[list[float]]) -> list[tuple[int, int]]:
    """Assignment of the greatest total worth, over all subsets of the columns; for up to eight columns."""
    best: dict[int, tuple[float, tuple[tuple[int, int], ...]]] = {0: (0.0, ())}
    for i, row in enumerate(worth):
        after = dict(best)
        for used, (total, pairs) in best.items():
            for j, w in enumerate(row):
                if w and not used >> j & 1:
                    key = used | 1 << j
                    if key not in after or after[key][0] < total + w:
                        after[key] = (total + w, (*pairs, (i, j)))
        best = after
    return list(max(best.items(), key=lambda kv: (kv[1][0], -kv[0]))[1][1])


def _assign_many(worth: list[list[float]]) -> list[tuple[int, int]]:
    """The same by shortest augmenting paths, for any number of columns."""
    n, m = len(worth), max(len(worth), len(worth[0]))
    cost = [[-w for w in row] + [0.0] * (m - len(row)) for row in worth]
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, back, seen = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[at]:
            seen[at] = True
            row, delta, to = owner[at], float("inf"), 0
            for j in range(1, m + 1):
                if not seen[j]:
                    c = cost[row - 1][j - 1] - u[row] - v[j]
                    if c < least[j]:
                        least[j], back[j] = c, at
                    if least[j] < delta:
                        delta, to = least[j], j
            for j in range(m + 1):
                if seen[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            at = to
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    return [(owner[j] - 1, j - 1) for j in range(1, len(worth[0]) + 1) if owner[j] and worth[owner[j] - 1][j - 1]]


def assign(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions (in a, in b) of the tokens matched by the assignment of the greatest worth."""
    worth = [[affinity(x, y)[0] for y in b] for x in a]
    return _assign_few(worth) if len(b) <= 8 else _assign_many(worth)


def _whole(a: list[str], b: list[str]) -> str | None:
    pairs = assign(a, b)
    mine, theirs = {i for i, _ in pairs}, {j for _, j in pairs}
    over_a, over_b = [t for i, t in enumerate(a) if i not in mine], [t for j, t in enumerate(b) if j not in theirs]
    if any(len(t) > 1 for t in over_a + over_b) or (over_a and over_b):
        return None
    solid = sum(len(a[i]) > 1 for i in mine)
    if (over_a or over_b) and solid < 2:
        return None
    found = [affinity(a[i], b[j]) for i, j in pairs]
    if not any(w >= 0.9 and len(a[i]) > 1 for (w, _), (i, _j) in zip(found, pairs, strict=True)):
        return None
    return "weak" if any(initial for _, initial in found) else "strong"


def match(a: list[str], b: list[str]) -> str | None:
    """strong: every word matched; weak: by an initial or an acronym; None: different names."""
    if min(len(a), len(b)) < 2 or max(len(a), len(b)) > MAX_TOKENS:
        return None
    # Most candidates have a word that nothing in the other name matches; no assignment covers it.
    may = all(len(x) == 1 or any(affinity(x, y)[0] for y in b) for x in a) and all(len(y) == 1 or any(affinity(x, y)[0] for x in a) for y in b)
    found = _whole(a, b) if may else None
    if found:
        return found
    for short, long in ((a, b), (b, a)):
        for i, t in enumerate(short):
            if 2 <= len(t) <= 5:
                for j in range(len(long) - len(t) + 1):
                    if "".join(x[0] for x in long[j : j + len(t)]) == t and len(long) > len(t):
                        rest_a, rest_b = short[:i] + short[i + 1 :], long[:j] + long[j + len(t) :]
                        if rest_a and rest_b and _whole(rest_a, rest_b) == "strong":
                            return "weak"
    return None


def _deletes(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))


def token_neighbours(vocabulary: DataFrame) -> DataFrame:
    """Rows (a, b), both ways, of tokens a small edit apart, from a table with one column ``token``."""
    long_ones = vocabulary.where(F.length("token") >= 4)
    once = fence(long_ones.select("token", _deletes(F.col("token")).alias("d1")))
    twice = F.when(F.length("token") >= 7, F.flatten(F.transform("d1", _deletes))).otherwise(F.array().cast("array<string>"))
    index = once.select("token", F.explode(F.array_distinct(F.concat(F.array("token"), F.col("d1"), twice))).alias("left"))
    pairs = pairs_within(index, "left", "token", F.col("a_token") < F.col("b_token")).select(F.col("a_token").alias("a"), F.col("b_token").alias("b")).distinct()
    # A swap of neighbours costs two here and one in ``close``, which decides.
    limit = F.when((F.greatest(F.length("a"), F.length("b")) >= 8) & (F.least(F.length("a"), F.length("b")) >= 7), F.lit(4)).otherwise(F.lit(2))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[close(a, b) for a, b in zip(batch["a"], batch["b"], strict=True)]]

    pairs = cut(pairs.where(F.levenshtein("a", "b") <= limit).mapInPandas(decide, "a string, b string"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _token_keys(vocabulary: DataFrame) -> DataFrame:
    """Rows (token, keys) from (token, df): tokens that match whole share a key. Single letters have none."""
    edges = token_neighbours(vocabulary.select("token"))
    df = lambda t: vocabulary.select(F.col("token").alias(t), F.col("df").alias(f"df_{t}"))
    # Of two neighbours the more frequent one is the key of both, so that its list grows by the few forms of its slips.
    larger = F.struct("df_b", "b") > F.struct("df_a", "a")
    near = edges.join(df("a"), "a").join(df("b"), "b").where(larger).groupBy("a").agg(F.collect_list("b").alias("near"))
    bases = F.create_map(*[x for name, forms in sorted(GIVEN.items()) for x in (F.lit(name), F.array(*[F.lit("~" + f) for f in sorted(forms)]))])
    none = F.array().cast("array<string>")
    known = vocabulary.where(F.length("token") > 1).join(near, F.col("token") == F.col("a"), "left")
    return known.select("token", F.concat(F.array("token"), F.coalesce("near", none), F.coalesce(F.try_element_at(bases, F.col("token")), none)).alias("keys"))


def _ways(tokens: list[str], keys: list[list[str]], j: int) -> list[str]:
    """Keys of the ways in which token ``j`` can match: = whole, i and a as the shorter side of an initial or abbreviation, I and A as the longer one, c as an acronym."""
    t = tokens[j]
    out = [f"={k}" for k in keys[j] or [t]]
    if len(t) == 1:
        return [*out, f"i{t}"]
    out += [f"I{x}" for x in {t[0], *(x[0] for x in GIVEN.get(t, ()))}]
    out += [f"A{t[0]}{x}" for x in set(t[1:])]
    if len(t) <= 6:
        out.append(f"a{t[:2]}")
    return [*out, f"c{t}"] if len(t) <= 5 else out


def _refined(tokens: list[str], keys: list[list[str]], counts: list[int], at: int) -> tuple[set[str], set[str]]:
    """Keys under the anchor at ``at``: those of the rarest other token, and those of all others. The first meet the second of another form turned by ``FACING``."""
    others = [j for j in range(len(tokens)) if j != at]
    first = "".join(t[0] for t in tokens)
    runs = [(p, p + n) for n in range(2, 6) for p in range(len(tokens) - n + 1) if not p <= at < p + n]
    rarest = min(others, key=lambda j: (len(tokens[j]) == 1, counts[j], tokens[j]))
    mine = {*_ways(tokens, keys, rarest), *(f"C{first[p:q]}" for p, q in runs if p <= rarest < q)}
    every = {k for j in others for k in _ways(tokens, keys, j)} | {f"C{first[p:q]}" for p, q in runs}
    return mine, every


FACING = str.maketrans("iIaAcC", "IiAaCc")


def name_links(forms: DataFrame) -> DataFrame:
    """Rows (a, b, kind), a < b, of all forms that ``match``, from distinct forms (form, tokens)."""
    few = forms.where(F.size("tokens") <= MAX_TOKENS)
    flat = cut(few.select("form", F.posexplode("tokens").alias("at", "token")))
    vocabulary = cut(flat.groupBy("token").agg(F.count_distinct("form").alias("df")))
    keyed = cut(flat.join(vocabulary.join(_token_keys(vocabulary), "token", "left"), "token").select("form", "at", "token", "df", F.coalesce("keys", F.array().cast("array<string>")).alias("keys")))
    held = keyed.select("form", "at", F.explode("keys").alias("key"))
    hot = cut(held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"))
    before = F.col("a_form") < F.col("b_form")
    pair = lambda df: df.select(F.least("a_form", "b_form").alias("a"), F.greatest("a_form", "b_form").alias("b"))
    plain = cut(held.join(hot, "key", "left_anti").select("key", "form").distinct())
    found = pair(pairs_within(plain, "key", "form", before))

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for form, parts, anchors in zip(batch["form"], batch["parts"], batch["anchors"], strict=True):
                parts = sorted(parts, key=lambda p: p["at"])
                tokens, keys, counts = [p["token"] for p in parts], [list(p["keys"]) for p in parts], [p["df"] for p in parts]
                found = set()
                for x in anchors:
                    mine, every = _refined(tokens, keys, counts, x["at"])
                    found |= {(f"{x['key']}\t{k[0].translate(FACING)}{k[1:]}", True) for k in mine} | {(f"{x['key']}\t{k}", False) for k in every}
                rows += [(k, form, asks) for k, asks in found]
            yield pd.DataFrame(rows, columns=["key", "form", "asks"])

    # One row for each form that holds a hot key: its tokens are at most MAX_TOKENS.
    anchors = held.join(hot, "key").groupBy("form").agg(F.collect_list(F.struct("at", "key")).alias("anchors"))
    parts = keyed.join(anchors.select("form"), "form", "left_semi").groupBy("form").agg(F.collect_list(F.struct("at", "token", "df", "keys")).alias("parts"))
    refined = cut(parts.join(anchors, "form").mapInPandas(refine, "key string, form string, asks boolean"))
    found = found.unionByName(pair(pairs_across(refined.where("asks").select("key", "form"), refined.where("not asks").select("key", "form"), "key", "form", F.col("a_form") != F.col("b_form"))))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kind = [match(a.split(" "), b.split(" ")) for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield batch.assign(kind=kind)[lambda x: x["kind"].notna()]

    return cut(found.distinct().mapInPandas(verify, "a string, b string, kind string"))


def link_names(names: DataFrame, name: str) -> DataFrame:
    """Rows (name, actor): each distinct name of the column with the actor it belongs to, named by the actor's smallest form."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [tokens(x) for x in batch["name"]]
            out = pd.DataFrame({"name": batch["name"], "form": [" ".join(t) for t in found], "tokens": found})
            yield out[[len(t) >= 2 for t in found]]

    rows = names.select(F.col(f"`{name}`").cast("string").alias("name")).where("name is not null").distinct()
    rows = cut(rows.mapInPandas(read, "name string, form string, tokens array<string>"))
    forms = cut(rows.select("form", "tokens").dropDuplicates(["form"]))
    links = name_links(forms)
    strong = connected_components(links.where("kind = 'strong'").select("a", "b"))
    actors = cut(forms.select("form").join(strong, F.col("form") == F.col("node"), "left").select("form", F.coalesce("component", "form").alias("actor")))
    # A weak form is the one with initials or an acronym: fewer letters than what it stands for.
    weak = links.where("kind = 'weak'").select(F.when(F.length("a") < F.length("b"), F.col("a")).otherwise(F.col("b")).alias("w"), F.when(F.length("a") < F.length("b"), F.col("b")).otherwise(F.col("a")).alias("x"))
    at = lambda c, to: actors.select(F.col("form").alias(c), F.col("actor").alias(to))
    joins = weak.join(at("w", "from"), "w").join(at("x", "to"), "x").where(F.col("from") != F.col("to")).groupBy("from").agg(F.min("to").alias("lowest"), F.max("to").alias("highest"))
    joins = joins.where("lowest = highest").select("from", F.col("lowest").alias("to"))
    merged = actors.join(joins, F.col("actor") == F.col("from"), "left").select("form", F.coalesce("to", "actor").alias("actor"))
    return cut(rows.select("name", "form").join(merged, "form").select("name", "actor"))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """Rows (name_a, name_b), name_a < name_b, of the names of one actor."""
    return pairs_within(linked, "actor", "name", F.col("a_name") < F.col("b_name")).select(F.col("a_name").alias("name_a"), F.col("b_name").alias("name_b")).distinct()
