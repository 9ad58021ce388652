import random
from itertools import combinations, permutations

from quillstone.llm import names


def _m(a, b):
    return names.match(names.tokens(a), names.tokens(b))


def test_variants_match():
    for a, b in [
        ("Hussein Gedrosojit", "Dr Hussein Gedr0sojit"), ("PATUVUTIR Katherine", "Katherine Patuvutir"), ("Zedrekludrum, Frederick", "Fred Zedrekludrum"), ("Hukriplolav Lib. Front", "Liberation Front of Hukriplolav"),
        ("Vol. Bn of Vifitridrim", "the Vifitridrim Volunteer Battalion"), ("Paskakruskav-Mining-Company", "Paskakruskav Mining Co."), ("Hussein K. Gedrosojit", "Hussein Gedrosojit"), ("Doskifufal Human RightsCommittee", "Doskifufal Human Rts Cttee"),
        ("Sasha Mimushakus", "Alexander Mimushakus"), ("Khadija Stámodreshol", "khadija stamodreshol"), ("Zejaplevut National Army (ZNA)", "Zejaplevut Natl Army"),
    ]:
        assert _m(a, b) == "strong", (a, b)
    assert _m("G. Jeplogozek", "Guadalupe Jeplogozek") == "weak" and _m("Taglilovun SS", "Taglilovun Security Service") == "weak" and _m("Paskakruskav M.C.", "Paskakruskav Mining Company") == "weak"


def test_different_actors_do_not_match():
    for a, b in [("Eduardo Krustegrasha", "Johannes Krustegrasha"), ("Duteshanan Minority Villagers", "Duteshanan Tribal Assembly"), ("Taglilovun Security Service", "Zejaplevut Security Service"), ("Daniel Gedrosojit", "Daniel"), ("farm workers", "displaced families"), ("M. Brolupabrok", "Joseph Brolupabrok")]:
        assert _m(a, b) is None, (a, b)


def test_distance_against_brute_force():
    assert names.distance("martha", "marhta") == 1 and names.distance("abc", "abcd") == 1 and names.distance("", "") == 0 and names.distance("kitten", "sitting") == 3


def test_assignment_against_brute_force():
    rng = random.Random(4)
    words = ["william", "bill", "w", "godrezezin", "godrezezyn", "x", "natl", "national", "robert", "bob"]
    for _ in range(200):
        n = rng.randint(1, 4)
        a, b = rng.choices(words, k=n), rng.choices(words, k=n)
        worth = [[names.affinity(x, y)[0] for y in b] for x in a]
        best = max(sum(worth[i][p[i]] for i in range(n)) for p in permutations(range(n)))
        for pairs in (names._assign_few(worth), names._assign_many(worth)):
            assert abs(sum(worth[i][j] for i, j in pairs) - best) < 1e-9 and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def test_long_names_are_compared_too():
    words = [f"word{chr(97 + i)}{chr(107 - i)}" * 2 for i in range(11)]
    assert names.match(words, words[::-1]) == "strong" and names.match([*words, "extra"], words) is None
    many = [f"w{i}x" for i in range(names.MAX_TOKENS + 1)]
    assert names.match(many, many[::-1]) is None


def _links(spark, all_names):
    forms = {" ".join(t): t for t in map(names.tokens, all_names) if len(t) >= 2}
    df = spark.createDataFrame(list(forms.items()), "form string, tokens array<string>")
    got = {tuple(r) for r in names.name_links(df).collect()}
    want = {(a, b, k) for a, b in combinations(sorted(forms), 2) if (k := names.match(forms[a], forms[b]))}
    return got, want


def test_links_equal_match_over_all_pairs(spark, monkeypatch):
    stored = spark.read.parquet("/root/testdata/sf0.01/mentions.parquet").where("label in ('PERSON', 'ORG', 'GROUP')").select("text").distinct().orderBy("text").limit(700).collect()
    short = ["Li Na", "Na Li", "Bob Lee", "Robert Lee", "R Lee", "Ro Lee", "Roberto T. Lee", "R. T. Lee", "Lee R.", "Lee National Guard", "Lee NG", "Natl Guard Lee", "Guard of Lee"]
    all_names = [r[0] for r in stored] + short
    for hot in (names.HOT, 2, 0):
        monkeypatch.setattr(names, "HOT", hot)
        got, want = _links(spark, all_names if hot else all_names[-150:])
        assert got == want and {k for _, _, k in got} == {"strong", "weak"}


def test_a_thousand_forms_of_one_family_name(spark):
    more = [f"{chr(97 + i // 40)}{chr(98 + i % 25)}o{chr(97 + i % 26)}iv{i % 7}ek Gedrosojit" for i in range(1000)]
    df = spark.createDataFrame([(n,) for n in ["Bob Gedrosojit", "Robert Gedrosojit", "Li Na", "Na Li", "Bob Lee", "Robert Lee", *more]], "name string")
    got = {tuple(r) for r in names.variant_pairs(names.link_names(df, "name")).collect()}
    assert {("Bob Gedrosojit", "Robert Gedrosojit"), ("Li Na", "Na Li"), ("Bob Lee", "Robert Lee")} <= got


def test_link_names(spark):
    actor1 = ["Joseph Plufotufus", "Judge Joseph Plufotufus", "Joseph  Plufotufus", "JOSEPH PLUFOTUFUS", "Joe Plufotufus", "Plufotufus J.", "Josehp Plufotufus"]
    actor2 = ["Patricia Plufotufus", "Pat Plufotufus"]
    actor3 = ["Karvessa National Guard", "Karvessa NG", "National Guard of Karvessa", "Karvesa National Guard"]
    loose = ["civilians", "Vadoria", "VADORIA", "", "farm workers", "x" * 5000]
    rows = [(n,) for n in actor1 + actor2 + actor3 + loose] * 2 + [(None,)]
    df = spark.createDataFrame(rows, "name string").selectExpr("name", "1 as form", "'x' as actor")
    got = {tuple(r) for r in names.variant_pairs(names.link_names(df, "name")).collect()}
    want = {tuple(sorted(p)) for group in (actor1, actor2, actor3) for p in combinations(group, 2)}
    assert got == want
    assert names.link_names(df.limit(0), "name").count() == 0


def test_ambiguous_initial_joins_nobody(spark):
    df = spark.createDataFrame([("J. Plufotufus",), ("Joseph Plufotufus",), ("Jovan Plufotufus",)], "name string")
    assert names.variant_pairs(names.link_names(df, "name")).count() == 0


def test_nicknames_and_initials_meet_under_a_common_name(spark, monkeypatch):
    monkeypatch.setattr(names, "HOT", 3)
    groups = [["Robert Gedrosojit", "Bob Gedrosojit", "R. Gedrosojit"], ["William Gedrosojit", "Bill Gedrosojit", "Willie Gedrosojyt", "William Gedrosoyit"], ["Zeynep Gedrosojit", "Zeynep Gedrosoqit", "Xeynep Gedrosojit"], ["HUSSEIN Gedrosojit", "Hussein Gedrosojit", "Gedrosojit, Hussain"]]
    # Given names that are rare and hot, and slips of the family name in more than three forms.
    more = [f"William {x}" for x in ("Tovarek", "Milasun", "Ostrabel", "Kelverin")] + [f"{g} Gedrosoqit" for g in ("Osman", "Emina", "Daniel", "Ulrich")]
    df = spark.createDataFrame([(n,) for g in groups for n in g] + [(n,) for n in more], "name string")
    got = {tuple(r) for r in names.variant_pairs(names.link_names(df, "name")).collect()}
    assert got == {tuple(sorted(p)) for g in groups for p in combinations(g, 2)}
