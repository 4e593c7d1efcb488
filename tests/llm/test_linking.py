import random

import pytest

from windrow.llm import linking as L

GENERA = ["Bridretelella", "Brimorphaium", "Trilotasa", "Zandrecynum", "Melrhacora", "Vavaquiis", "Kosulorisa"]
EPITHETS = ["polfalostata", "dreixolirula", "ostostgraoides", "helbriixoosa", "mipixopolinum", "ristricorinum", "zantaspolicans", "morkosbriensis"]


def entries():
    out, k = [], 1
    for g in GENERA:
        out.append((k, g, None, []))
        k += 1
        for i, e in enumerate(EPITHETS):
            if (len(g) + i) % 3:
                out.append((k, f"{g} {e}", g, [f"Rhaduemorella {e}{g[:2].lower()}"] + (["ferny thimble reed"] if k == 12 else [])))
                k += 1
    return out


ENTRIES = entries()
G = L.Gazetteer(ENTRIES)
SPECIES = [(k, n, p) for k, n, p, _ in ENTRIES if p]


@pytest.mark.parametrize("k,name,parent", SPECIES)
def test_forms_of_a_name(k, name, parent):
    genus, epithet = name.split()
    forms = [name, name.upper(), f'"{name}"', f"  {genus}   {epithet} ", f"{genus}_{epithet}", f"{genus}-{epithet}", f"{genus}, {epithet}", f"{genus}{epithet}", f"{epithet} {genus}", f"cf. {name}", f"{genus} aff. {epithet}", f"{name} strain R71", f"{name} (juvenile)", f"{name}, Tarnfield 1888", f"{name} (Harnmoor, 1871)", f"{name} subsp. minor", f"{name} auct. non Sedley", f"genus {genus}, species {epithet}", name.replace("o", "0").replace("l", "1"), name.replace("a", "а").replace("e", "е"), "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in name), name.replace("e", "é"), f"{name} - adult form", f"{name} (?)"]
    assert [f for f in forms if G.match(f, None) != k] == []
    assert G.match(f"{genus[:1]}. {epithet}", parent) == k


def test_held_out_typing_errors():
    rng = random.Random(6)
    right = total = 0
    for k, name, _ in SPECIES * 6:
        i = rng.randrange(1, len(name) - 1)
        while name[i] == " " or name[i - 1] == " ":
            i = rng.randrange(1, len(name) - 1)
        c = rng.choice("abcdefghijklmnoprstu")
        typed = rng.choice([name[:i] + name[i + 1 :], name[:i] + c + name[i:], name[:i] + c + name[i + 1 :], name[: i - 1] + name[i] + name[i - 1] + name[i + 1 :]])
        right += G.match(typed, None) == k
        total += 1
    assert right >= 0.97 * total


@pytest.mark.parametrize("value", ["", "?", "none", "N/A", "not stated", "unknown ?", "small brown one", "several beetles", "mixed culture,", "sample 14", "host plant", "Bridretelella nutasulum", "Gravergnoodes polfalostulum", "x"])
def test_unmatched(value):
    assert G.match(value, None) == 0
    assert G.match(value, "Bridretelella") == 0


def test_genus_only_synonyms_and_parents():
    ids = {n: k for k, n, *_ in ENTRIES}
    for form in ("Trilotasa", "trilotasa sp.", "genus Trilotasa", "Trilotasa species", "Trilotasa (all forms)", "Triilotasa"):
        assert G.match(form, None) == ids["Trilotasa"]
    assert G.match("ferny  thimble reed", None) == 12
    assert G.match("B. ostostgraoides", None) in (0, ids.get("Brimorphaium ostostgraoides"), ids.get("Bridretelella ostostgraoides"))
    two = L.Gazetteer([(1, "Alba mira", "Alba", []), (2, "Arda mira", "Arda", ["Alba mira"])])
    assert two.match("Alba mira", "Arda") == 2 and two.match("Alba mira", "Alba") == 1 and two.match("A. mira", "Arda") == 2


def test_cosines_against_brute_force():
    import numpy as np

    names = [s for *_, s in G.names]
    for q in ("bridretelellapolfalostata", "trilotasadreixo", "zzz", "kosulorisa"):
        got = G.cosines(q, 0.2)
        terms = sorted(G.term)

        def vec(s):
            g = L._grams(s)
            return np.array([(1 + np.log(g[t])) * G.idf[G.term[t]] if t in g else 0.0 for t in terms]), sum(((1 + np.log(c)) * G.unseen) ** 2 for t, c in g.items() if t not in G.term)

        v, extra = vec(q)
        brute = {}
        for k, n in enumerate(names):
            w, _ = vec(n)
            c = float(v @ w / np.sqrt((v @ v + extra) * (w @ w))) if (v @ v + extra) > 0 else 0.0
            if c >= 0.2:
                brute[k] = c
        assert got.keys() == brute.keys() and all(abs(got[k] - brute[k]) < 1e-9 for k in got)


def test_edits():
    assert L.edits("abcd", "abdc", 2) == 1 and L.edits("abcd", "abcd", 2) == 0 and L.edits("abc", "xyz", 2) == 3 and L.edits("ab", "abcde", 2) == 3


def test_operator(spark):
    gz = spark.createDataFrame([(k, n, p, s) for k, n, p, s in ENTRIES] + [(None, "lost", None, [])], "taxon_id long, name_txt string, parent_genus string, synonyms array<string>").selectExpr("*", "1 as taxon")
    g = L.gazetteer_of(gz)
    rows = [("o1", "Trilotasa", None, None), ("o1", "Trilotasa", None, None), ("o2", None, "zandrecynum polfalostata", None), ("o3", " ", None, None), ("o4", "x" * 20_000, None, None), ("o5", "none", "none", "Trilotasa")]
    df = spark.createDataFrame(rows, "organism_id string, name_raw string, name_normalized string, parent_genus string").selectExpr("*", "1 as _value", "2 as taxon_id")
    got = {r.organism_id: r.taxon_id for r in L.link_names(df, g, "organism_id", ["name_raw", "name_normalized"], "parent_genus").collect()}
    ids = {n: k for k, n, *_ in ENTRIES}
    assert got == {"o1": ids["Trilotasa"], "o2": ids.get("Zandrecynum polfalostata", 0), "o3": 0, "o4": 0, "o5": 0}
    assert L.link_names(df.limit(0), g, "organism_id", ["name_raw"]).collect() == []
    assert L.gazetteer_of(gz.limit(0)).match("Trilotasa", None) == 0


def test_groups_of_the_list_give_what_one_index_gives(spark):
    gz = spark.createDataFrame([(k, n, p, list(s or [])) for k, n, p, s in ENTRIES], "taxon_id long, name_txt string, parent_genus string, synonyms array<string>")
    typed = [n for _, n, *_ in ENTRIES[:40]] + [n.replace("o", "0", 1) for _, n, *_ in ENTRIES[:40]] + [f"{n[:1]}. {n.split()[-1]}" for _, n, *_ in ENTRIES[:40]] + ["nothing like it", "", None]
    df = spark.createDataFrame([(f"o{i}", t, None if i % 2 else "Trilotasa") for i, t in enumerate(typed)], "organism_id string, name_raw string, parent_genus string")
    whole = {tuple(r) for r in L.link_names(df, G, "organism_id", ["name_raw"], "parent_genus").collect()}
    for bound in ({"most_names": 10}, {"most_bytes": 20_000}, {}):
        assert {tuple(r) for r in L.link_to_list(df, gz, "organism_id", ["name_raw"], "parent_genus", **bound).collect()} == whole
    assert sum(t > 0 for _, t in whole) > 60


def test_a_key_with_two_meanings_has_none(spark):
    two = [n for k, n, *_ in ENTRIES if len(n.split()) == 2][:2]
    df = spark.createDataFrame([("a", two[0]), ("a", two[1]), ("b", two[0]), ("b", "nothing like it"), ("c", two[0]), ("c", two[0])], "organism_id string, name_raw string")
    got = {r[0]: r[1] for r in L.link_names(df, G, "organism_id", ["name_raw"]).collect()}
    assert got["a"] == 0 and got["b"] == got["c"] > 0
