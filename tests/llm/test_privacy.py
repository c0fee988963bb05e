import re

import pytest

from quern.llm import privacy

GIVEN = [s + e for s in ("Bram", "Dag", "Eld", "Fenn", "Hal", "Ild", "Jel", "Kest", "Lum") for e in ("al", "en", "ena", "et", "ira", "or")]
FAMILY = [s + e for s in ("Brenn", "Crop", "Dusk", "Fask", "Grent", "Hollo", "Jarv", "Kirr", "Lind") for e in ("ani", "ard", "enko", "holt", "mere", "wick")]
LISTED = [(g, "given") for g in GIVEN if g not in ("Elden", "Halor")] + [(f, "family") for f in FAMILY if f != "Cropwick"] + [(None, "given"), ("X", None)]
# text, then the mentions in it by kind
CASES = [
    ("Write to bramal.duskmere@mail.x-lab.example.com for access.", [("email", "bramal.duskmere@mail.x-lab.example.com")]),
    ("The maintainer <eldo+index (at) mail dot foo dot invalid> replied; schema@v1.2, shard@node5, @Override", [("email", "eldo+index (at) mail dot foo dot invalid")]),
    ("Long: " + "x" * 300 + ".y@" + "d" * 60 + ".example.com", [("email", "x" * 300 + ".y@" + "d" * 60 + ".example.com")]),
    ("mailto:a.b [at] c.example or X_Y@Z.TEST.", [("email", "a.b [at] c.example"), ("email", "X_Y@Z.TEST")]),
    ("We met at the quarry. Voicemail at +1 (588) 555-0140 is full.", [("phone", "+1 (588) 555-0140")]),
    ("tel:+49 30 23125 759\nFax 01 99 00 05 49. (417) 555 0112; 432-555-0115, 01632 960867", [("phone", p) for p in ("+49 30 23125 759", "01 99 00 05 49", "(417) 555 0112", "432-555-0115", "01632 960867")]),
    ("[2026-03-18 17:32:28] build 4.44.269, Doc ids 128-256, Run 20251057-75120, pubtime=1771133069, Ticket INC-90852", []),
    ("SSN 926-70-7528, Tax ID 47.559.015-K. passport no. KE7106961, personal no: 858205-1779, national ID 00 973 211 760", [("id_number", p) for p in ("926-70-7528", "47.559.015-K", "KE7106961", "858205-1779", "00 973 211 760")]),
    ("kept at 84 Saffron Street (rear), 12B ORCHARD COURT; An 6 Way merge beats a 10 Lane scan on row 5.", [("address", "84 Saffron Street"), ("address", "12B ORCHARD COURT")]),
    ("Haus Erlengasse 75 in X. au 69 avenue des Trois Hérons à Y. en Calle Molino Azul 64, Z. C/ Brezo 44, Y", [("address", "Erlengasse 75"), ("address", "69 avenue des Trois Hérons"), ("address", "Calle Molino Azul 64"), ("address", "C/ Brezo 44")]),
    ("Mr Bramal F. Brennani and Ms Kestor LINDARD; Duskwick, Fennira. P. Jarvmere; Lumet Hollomere-Cropard", [("name", n) for n in ("Bramal F. Brennani", "Kestor LINDARD", "Duskwick, Fennira", "P. Jarvmere", "Lumet Hollomere-Cropard")]),
    ("Unlisted: Elden Cropwick. Lone: The Duskholt heuristic is older than the Bramal codec.", [("name", "Elden Cropwick")]),
    ("​Tax​ ID 47.55​9.015-6", [("id_number", "47.55​9.015-6")]),
]


def frames(spark, rows):
    return spark.createDataFrame([(*r, 1, "e") for r in rows], "doc_id bigint, text string, start_pos int, entity string"), spark.createDataFrame(LISTED, "name string, name_kind string")


def test_mentions(spark):
    docs, names = frames(spark, [(i, t) for i, (t, _) in enumerate(CASES)] + [(90, None), (91, ""), (0, CASES[0][0])])
    got = {}
    for r in privacy.mentions(docs, names).orderBy("doc_id", "start_pos").collect():
        assert CASES[r.doc_id][0][r.start_pos - 1 : r.end_pos] == r.mention
        got.setdefault(r.doc_id, []).append((r.kind, r.mention))
    for i, (_, want) in enumerate(CASES):
        assert got.get(i, []) == want
    assert privacy.mentions(docs.limit(0), names).count() == 0
    assert privacy.mentions(docs, names.limit(0)).where("kind = 'name'").count() == 0


def test_placeholders_keep_the_rest(spark):
    docs, names = frames(spark, [(i, t) for i, (t, _) in enumerate(CASES)] + [(90, None), (91, "")])
    got = {r.doc_id: r.text for r in privacy.replace(docs, names, "k", "placeholder").collect()}
    assert got[90] is None and got[91] == "" and len(got) == len(CASES) + 2
    for i, (text, want) in enumerate(CASES):
        parts = [re.escape(p) for p in re.split("|".join(re.escape(m) for _, m in want), text)] if want else [re.escape(text)]
        pattern = parts[0] + "".join(rf"\[{kind.upper()}_[0-9a-f]{{12}}\]{p}" for (kind, _), p in zip(want, parts[1:], strict=True))
        assert re.fullmatch(pattern, got[i], re.S)


def test_surrogates_are_consistent_and_distinct(spark):
    people = [f"{g} {f}" for g in GIVEN[:25] for f in FAMILY[:12]]
    rows = [(i, f"by {p}, call 432-555-{i:04d}") for i, p in enumerate(people)] + [(5000, "Brennani, Bramal and BRAMAL BRENNANI and bramal.x@y.test"), (5001, "Call 432.555.0003 or (432) 555-0003")]
    docs, names = frames(spark, rows)
    out = privacy.replaced_mentions(docs, names, "k").toPandas()
    for kind in ("name", "phone"):
        mine = out[(out.kind == kind) & (out.doc_id < 5000)]
        assert mine.replacement.nunique() == mine.entity.nunique() == len(people)
    bramal = out[out.mention == "Bramal Brennani"].replacement.iloc[0]
    first, last = bramal.split()
    assert set(out[(out.doc_id == 5000) & (out.kind == "name")].replacement) == {f"{last}, {first}", bramal.upper()}
    assert all(m[0].endswith("a") == r.split()[0].endswith("a") for m, r in ((m.split(), r) for m, r in zip(out[out.kind == "name"].mention, out[out.kind == "name"].replacement, strict=True) if "," not in m and not m.isupper()))
    three = out[(out.kind == "phone") & (out.entity == "4325550003")].replacement
    assert len({re.sub(r"\D", "", r) for r in three}) == 1 and all(re.sub(r"\d", "9", a) == re.sub(r"\d", "9", b) for a, b in zip(out[out.kind == "phone"].mention, out[out.kind == "phone"].replacement, strict=True))
    assert not set(out[out.kind == "name"].replacement.str.lower()) & {p.lower() for p in people}  # no surrogate is a person of the corpus
    joined = {(r.doc_id, r.start_pos): r.replacement for r in out.itertuples()}
    for r in privacy.replace(docs, names, "k").collect():
        mine = [v for (d, _), v in joined.items() if d == r.doc_id]
        assert mine and all(v in r.text for v in mine)
    with pytest.raises(ValueError):
        privacy.replace(docs, names, "")
    other = privacy.replaced_mentions(docs, names, "other").toPandas()
    assert (other.sort_values(["doc_id", "start_pos"]).replacement.to_numpy() != out.sort_values(["doc_id", "start_pos"]).replacement.to_numpy()).mean() > 0.9
