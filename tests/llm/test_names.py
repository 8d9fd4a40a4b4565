import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm.names import NameIndex, Trie, fold, link_names, typed_words

ENTITIES = [
    ("c1", "COMPANY", "Grydakvist Textiles Semiconductors Corporation", ["Grydakvist Textiles Semiconductors", "GTSC"]),
    ("c2", "COMPANY", "Oskuvebrek Shipping Holdings", []),
    ("c3", "COMPANY", "Oskuvebrek Aerospace Limited", None),
    ("c4", "COMPANY", "Černoyard Foods S.A.", []),
    ("p1", "PERSON", "Edward Falrigoham", []),
    ("p2", "PERSON", "Margaret D. Rudmactetti", []),
    ("p3", "PERSON", "Susan Rudmactetti", []),
    ("b1", "CENTRAL_BANK", "Central Bank of Velmoria", []),
    ("b2", "COUNTRY", "Velmoria", []),
    ("g1", "GOVERNMENT", "Ministry of Trade of Velmoria", []),
    ("n1", "COMPANY", None, None),
    ("n2", "PERSON", "", []),
]
CASES = [
    ("grydakvist textiles semis corp", None, "c1"),
    ("GTSC", None, "c1"),
    ("G.T.S.C.", None, "c1"),
    ("GrydakvistTextiles Semi Co.", "COMPANY", "c1"),
    ("grydakvisttextiles", None, "c1"),
    ("Semiconductors Corp., Grydakvsit", None, "c1"),
    ("Grydakvist Mining Corp", None, None),
    ("Oskuvebrek", None, None),
    ("The Oskuvebrek Ship. Hldgs", None, "c2"),
    ("Oskuvebrek Aero Ltd", None, "c3"),
    ("CERNOYARD FOOSD", None, "c4"),
    ("Falrigoham, Ned G.", None, "p1"),
    ("Prof. Ed Falrigohma", "PERSON", "p1"),
    ("Falrigoham", None, None),
    ("Thomas Falrigoham", None, None),
    ("Peggy Rudmactetti", None, "p2"),
    ("M. P. Rudmactetti", None, None),
    ("M.D. Rudmactetti", None, "p2"),
    ("m.r. rudmactetti", "PERSON", None),
    ("D.R. Falrigoham", None, None),
    ("Rudmactetti S", "PERSON", "p3"),
    ("Edward Falrigoham", "COMPANY", None),
    ("Velmoria Centarl Bank", None, "b1"),
    ("CB Velmoria", None, "b1"),
    ("velmoria", None, "b2"),
    ("Trade Ministry, Velmoria", None, "g1"),
    ("", None, None),
    ("   ", None, None),
    ("?!", None, None),
    (None, None, None),
    ("x" * 100_000, None, None),
    ("a b c d e f g h i j k l m n", None, None),
    ("Oskuvebrek Shipping Holdings " + "inc " * 5000, None, None),
    ("Oskuvebrek" + " " * 2000 + "Shipping Holdings", None, "c2"),
    (" ".join(f"w{i}" for i in range(3000)), None, None),
    ("grydakvist thee ms textiles semiconductors corporation incorporated plc", None, "c1"),
]


def test_links(spark):
    aliases = spark.createDataFrame([(i, a, k, "clash") for i, (a, k, _) in enumerate(CASES)], "alias_id long, alias string, entity_type string, entity_id string")
    entities = spark.createDataFrame(ENTITIES, "entity_id string, entity_type string, canonical_name string, aliases array<string>")
    want = {i: w for i, (_, _, w) in enumerate(CASES) if w}
    for block in (50_000, 3):
        got = [(r.alias_id, r.entity_id) for r in link_names(aliases, entities, block=block).collect()]
        assert len(got) == len(set(got)) and dict(got) == want
    assert link_names(aliases, entities.limit(0)).count() == 0
    assert link_names(aliases.limit(0), entities).count() == 0


def distance(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=15), st.text("abc", min_size=1, max_size=7), st.integers(0, 2))
def test_trie_against_all_pairs(words, typed, k):
    trie = Trie(words)
    assert sorted(trie.near(typed, k)) == sorted((w, d) for w in set(words) if (d := distance(w, typed)) <= k)


def test_words():
    assert typed_words("The Côrambaroux  Int'l S.A.") == ["the", "corambaroux", "intl", "sa"]
    assert typed_words("KelvodagrundComm. Ltd.") == ["kelvodagrund", "comm", "ltd"]
    assert fold("ŁØß") == "loss"


def test_misspelt_once(spark):
    rng = random.Random(2)
    index = NameIndex(ENTITIES)
    for entity, kind, name, _ in ENTITIES[:3] + ENTITIES[4:7]:
        for _ in range(60):
            i = rng.randrange(1, len(name.split()[0]) - 1) if kind == "COMPANY" else len(name) - rng.randrange(2, 6)
            typo = name[:i] + rng.choice("xqz") + name[i + rng.randrange(2) :]
            found = index.find(typo, None)
            assert found and found[0][1] == entity and (len(found) == 1 or found[0][0] < found[1][0])


def test_blocks_share_their_words(spark):
    """A word of one block is no misspelling of another block's, and an earlier stage goes before a lower cost."""
    surnames = ["Jonas", "Jones", "Jonis", "Marten", "Martin", "Martens", "Petrow", "Petrov"]
    people = [(f"p{i}{j}", "PERSON", f"{given} {surname}", []) for i, given in enumerate(["Anna", "Peter", "Susan", "Zoe"]) for j, surname in enumerate(surnames) if (i + j) % 3 == 0]
    firms = [(f"c{j}", "COMPANY", f"{core} {kind} {legal}", []) for j, (core, kind, legal) in enumerate([("Orvalon", "Mining", "Limited"), ("Orvalon", "Shipping", "Holdings"), ("Orvelon", "Mining", "Group"), ("Jonas", "Foods", "plc")])]
    entities = spark.createDataFrame(people + firms, "entity_id string, entity_type string, canonical_name string, aliases array<string>")
    typed = [f"{given} {surname}{end}" for given in ("Anna", "Peter", "Sue", "Zoe", "Ana") for surname in surnames for end in ("", "s")] + ["Orvalon Mining", "Orvelon Minning", "Orvalun Shipping", "Orvlon Mng", "OMG", "Jonas Fods"]
    aliases = spark.createDataFrame([(i, a, None) for i, a in enumerate(typed)], "alias_id long, alias string, entity_type string")
    want = {tuple(r) for r in link_names(aliases, entities).collect()}
    assert want and "Anna Jones" not in {typed[i] for i, _, _ in want}
    for block in (1, 5):
        assert {tuple(r) for r in link_names(aliases, entities, block=block).collect()} == want


def test_names_beyond_the_test_table():
    people = ["Joseph Arlett", "Samuel Arlett", "Andrew Brondby", "Daniel Brondby", "Catherine Cravik", "Dmitri Cravik"]
    bodies = [("COMPANY", "Veltora Investments LLC"), ("GOVERNMENT", "Ministry of Finance of Dorland"), ("REGULATOR", "Dorland Securities Exchange Commission"), ("GOVERNMENT", "Dorland Department of Education")]
    index = NameIndex([(n, "PERSON", n, []) for n in people] + [(n, k, n, []) for k, n in bodies])
    for typed, want in (
        ("Joe Arlett", people[0]), ("Sam Arlett", people[1]), ("Andy Brondby", people[2]), ("Brondby, Dan", people[3]), ("Kate Cravik", people[4]), ("Dima Cravik", people[5]),
        ("Veltora Inv. LLC", "Veltora Investments LLC"), ("MOF Dorland", "Ministry of Finance of Dorland"), ("Dorland Sec. Exch Comm", "Dorland Securities Exchange Commission"), ("DSEC", "Dorland Securities Exchange Commission"), ("Dorland Dept of Educ", "Dorland Department of Education"),
    ):
        found = index.find(typed, None)
        assert found and found[0][1] == want and (len(found) == 1 or found[0][0] < found[1][0]), typed
    # a form of a word that no entity has doesn't stand in the way of a misspelling
    assert NameIndex([("e", "COMPANY", "Veltora Chemicals plc", [])]).find("Veltora Cem. plc", None)


def test_words_and_names_in_no_list():
    """Given names, lines of business and bodies that neither the lexicon nor the test tables have, shortened by the general rules."""
    people = ["Thorvald Esk", "Wendeline Esk", "Bartolomea Ruun", "Oswin Ruun"]
    bodies = [("COMPANY", "Tolvane Dredging LLC"), ("COMPANY", "Tolvane Viticulture LLC"), ("COMPANY", "Halverin Hospitality Group"), ("REGULATOR", "Fisheries Observation Secretariat of Quorn"), ("GOVERNMENT", "Ministry of Finance of Quorn"), ("COMPANY", "Ostrel Ornamental Glassworks plc")]
    index = NameIndex([(n, "PERSON", n, []) for n in people] + [(n, k, n, []) for k, n in bodies])

    def meant(typed):
        found = index.find(typed, None)
        return found[0][1] if found and (len(found) == 1 or found[0][0] < found[1][0]) else None

    for typed, want in (
        ("Thor Esk", people[0]), ("Wendy Esk", people[1]), ("Esk, Wendel", people[1]), ("Bartie Ruun", people[2]), ("Osw. Ruun", people[3]), ("Tolvane Dredg. LLC", "Tolvane Dredging LLC"), ("Tolvane Vitic", "Tolvane Viticulture LLC"), ("Tolvane Vtcltr", "Tolvane Viticulture LLC"),
        ("Halverin Hosp Grp", "Halverin Hospitality Group"), ("FOS of Quorn", "Fisheries Observation Secretariat of Quorn"), ("Quorn Fisheries Obs. Secr.", "Fisheries Observation Secretariat of Quorn"), ("MoF Quorn", "Ministry of Finance of Quorn"), ("Ostrel Orn. Glswks", "Ostrel Ornamental Glassworks plc"),
        ("Tolvane", None), ("Tolvane Mining", None), ("Esk", None), ("Halvard Esk", None), ("Ruun O", people[3]),
    ):
        assert meant(typed) == want, (typed, meant(typed))


def test_all_readings_are_weighed():
    """A reading found first isn't taken where another costs less, and two alike in cost mean nobody."""
    index = NameIndex([("a", "COMPANY", "Orla Beth Mining plc", []), ("b", "COMPANY", "Orlabeth Foods plc", []), ("c", "PERSON", "Maria Tond", []), ("d", "PERSON", "Mario Tond", [])])
    assert index.find("Orlabeth Foods", None)[0][1] == "b"
    assert index.find("Orla Beth Foods plc", None)[0][1] == "b"
    found = index.find("Marik Tond", None)
    assert len(found) == 2 and found[0][0] == found[1][0]
