from __future__ import annotations

import math

import pytest

from kartotek.operators.cleaning import keep_values
from kartotek.operators import wide_glm
from kartotek.operators.regression import fit_binomial
from kartotek.plans import clustering, company, durations
from kartotek.sources.json_lines import read_json
from kartotek.streaming import process_available, read_arriving

DUMP = [
    '{"_id":"1","_type":"virksomhed","_source":{"Vrvirksomhed":{"cvrNummer":20,"brancheAnsvarskode":96,'
    '"reklamebeskyttet":true,"virksomhedsstatus":[{"status":"NORMAL"},{"status":"Under Konkurs"}],'
    '"virksomhedMetadata":{"antalPenheder":2,"sammensatStatus":"Opløst efter konkurs","stiftelsesDato":"2001-02-03",'
    '"nyesteAarsbeskaeftigelse":{"aar":2014,"intervalKodeAntalAnsatte":"ANTAL_10_19"},'
    '"nyesteBeliggenhedsadresse":{"husnummerFra":1,"husnummerTil":3,"kommune":{"kommuneKode":101}},'
    '"nyesteBibranche1":{"branchekode":"4711"},"nyesteKontaktoplysninger":["a@b","c@d"],'
    '"nyesteStatus":{"statuskode":1},"nyesteVirksomhedsform":{"virksomhedsformkode":80,"kortBeskrivelse":"APS"}}}}}',
    '{"_id":"2","_type":"virksomhed","_source":{"Vrvirksomhed":{"cvrNummer":10,"virksomhedsstatus":[],'
    '"virksomhedMetadata":{"sammensatStatus":"Aktiv","stiftelsesDato":"bad","nyesteKontaktoplysninger":["e@f"],'
    '"nyesteKvartalsbeskaeftigelse":{"aar":2015}}}}}',
    '{"_id":"3","_type":"virksomhed","_source":{"Vrvirksomhed":{"cvrNummer":30,'
    '"virksomhedMetadata":{"nyesteKontaktoplysninger":[]}}}}',
    '{"_id":"4","_type":"deltager","_source":{"Vrdeltagerperson":{"enhedsNummer":5}}}',
    '{"_id":"5","_type":"andet"}',
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "dump.json"
    path.write_text("\n".join(DUMP))
    return company.companies(read_json(spark, str(path), company.ENVELOPE_SCHEMA)).cache()


def test_metadata(docs):
    flat = company.company_metadata(docs)
    assert len(flat.columns) == 47 and flat.count() == 3
    first = flat.filter("kontakt = 'a@b'").first()
    assert (first["cvrNummer"], first["husnummerfra"], first["husnummertil"], first["kommunekode"]) == (20, 1, 3, 101)
    assert company.company_metadata(docs, keep_without_contact=True).count() == 4


def test_metadata_of_an_inferred_schema(spark, tmp_path):
    (tmp_path / "d.json").write_text(DUMP[0])
    inferred = company.companies(read_json(spark, str(tmp_path)))
    flat = company.company_metadata(inferred)
    assert flat.count() == 2 and flat.first()["mndbeskfkvart"] is None
    typed = company.typed_companies(inferred).first()
    assert (typed["cvrnummer"], typed["antalAnsatte"], typed["branchekode3"]) == (20, 10, "None")
    (tmp_path / "d.json").write_text('{"_type":"virksomhed","_source":{"Vrvirksomhed":{"cvrNummer":1}}}')
    typed = company.typed_companies(company.companies(read_json(spark, str(tmp_path)))).first()
    assert (typed["cvrnummer"], typed["virksomhedsstatus"], typed["stiftelsesAar"]) == (1, "", None)


def test_yearly(docs):
    yearly = company.yearly_companies(company.company_metadata(docs))
    assert {r["cvrNummer"] for r in yearly.collect()} == {20}
    assert "kontakt" not in yearly.columns and yearly.first()["landkode"] == "ukendt"
    indexed = company.indexed_companies(yearly)
    assert [indexed.first()[c] for c in company.YEARLY_INDEXED.values()] == [0.0, 0.0, 0.0]


def test_feature_table(docs):
    table = company.feature_table(docs)
    assert table.columns == ["Index", *company.FEATURE_COLUMNS]
    got = {r["cvrnummer"]: r for r in table.collect()}
    assert [got[c]["Index"] for c in (10, 20, 30)] == [0, 1, 2]
    r = got[20]
    assert (r["nPenheder"], r["antalAnsatte"], r["branchekode1"], r["branchekode2"]) == (2, 10, "4711", "None")
    assert (r["sammensatStatus"], r["virksomhedsstatus"], r["stiftelsesAar"]) == ("opløstefterkonkurs", "underkonkurs", 2001)
    assert (r["brancheAnsvarskode"], r["reklamebeskyttet"], r["virksomhedsformkode"]) == ("96", 1, 80)
    assert (got[10]["stiftelsesAar"], got[10]["virksomhedsstatus"], got[10]["statuskode"]) == (None, "", "None")


def history(spark):
    data = [
        (1, ["2000-01-01", "2000-01-11"], ["2000-01-11", None], ["NORMAL", "Konkurs"]),
        (2, ["2000-01-01"], ["2000-01-02"], ["Normal"]),
        (3, ["2000-01-01"], ["2000-01-01"], ["ET DØGN"]),
    ]
    return spark.createDataFrame(data, "cvr long, gyldigFra array<string>, gyldigTil array<string>, status array<string>")


def test_durations(spark):
    got = {r["status"]: (r["n"], r["avg_days"]) for r in durations.mean_durations(history(spark)).collect()}
    assert got == {"normal": (2, 5.5), "konkurs": (1, 36515.0), "et døgn": (1, 1.0)}
    bars, curve = durations.duration_shapes(durations.durations(history(spark)))
    assert {r["status"] for r in bars.collect()} == {"normal", "konkurs"}
    assert sum(r["n"] for r in bars.collect()) == 3
    top = [r for r in curve.collect() if r["status"] == "normal" and r["edge_no"] == 0]
    assert top[0]["edge"] == 0 and top[0]["density"] > 0


@pytest.fixture(scope="module")
def table(spark):
    data = [
        (
            i,
            1000 + i,
            None if i % 7 == 0 else i % 4,
            None if i % 5 == 0 else i % 9,
            ["aktiv", "opløstefterkonkurs", "andet"][(i // 3 + i) % 3],
            "None" if i % 6 == 0 else str(i % 6),
            None if i % 11 == 0 else 1990 + i % 20,
        )
        for i in range(120)
    ]
    schema = "Index long, cvrnummer long, nPenheder long, antalAnsatte int, sammensatStatus string, brancheAnsvarskode string, stiftelsesAar int"
    return spark.createDataFrame(data, schema).cache()


@pytest.mark.parametrize("wide", [True, False])
def test_cluster_table(table, wide):
    run = clustering.cluster_table(table, k=3, wide=wide)
    width = 3 + 6 + 3
    assert run.scaled.first()["scaledfeatures"].size == width
    measured = clustering.distances(run.scaled, run.model)
    ranked = clustering.ranked_companies(table, measured).collect()
    assert len(ranked) == 120 and all(a["distance"] >= b["distance"] for a, b in zip(ranked, ranked[1:]))


def test_both_forms_have_the_same_geometry(table):
    a, b = (clustering.cluster_table(table, k=2, wide=w).scaled for w in (True, False))
    lengths = [{r[0]: sum(x * x for x in r[1]) for r in f.collect()} for f in (a, b)]
    assert all(math.isclose(lengths[0][i], lengths[1][i], rel_tol=1e-9) for i in range(120))


def test_status_training_rows(table):
    training, names = clustering.status_training_rows(table, left_out=("brancheAnsvarskode:None",))
    assert training.columns == ["Index", "label", "features"]
    assert "aar" in names and "stiftelsesAar" not in names and "brancheAnsvarskode:None" not in names
    assert training.count() == table.filter("sammensatStatus != 'andet'").count()
    assert fit_binomial(training).coefficients.size == len(names)


def test_status_training_vectors(table):
    out = ("brancheAnsvarskode:None",)
    wide, names = clustering.status_training_rows(table, left_out=out)
    training, numbers, dictionary = clustering.status_training_vectors(table, left_out=out)
    assert training.columns == ["Index", "label", "features"] and set(numbers) < set(names)
    terms = {r["term"] for r in dictionary.collect()}
    assert set(numbers) | terms == set(names) and not terms & {*numbers, *out}
    a, b = ({r[0]: (r[1], len(r[2]), sorted(x for x in r[2] if x)) for r in f.collect()} for f in (wide, training))
    assert a.keys() == b.keys()
    for i, (label, size, entries) in a.items():
        assert b[i][:2] == (label, size) and b[i][2] == pytest.approx(entries)
    assert wide_glm.fit_wide_binomial(training, tolerance=1e-6).coefficients.size == len(names)


def test_streaming(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "o_orderkey long, o_orderstatus string"
    def arrive(name, keys):
        (tmp_path / "in").mkdir(exist_ok=True)
        lines = [f'{{"o_orderkey":{k},"o_orderstatus":"{"FOP"[k % 3]}"}}' for k in keys]
        (tmp_path / "in" / name).write_text("\n".join(lines))

    def operator(frame):
        return keep_values(frame, "o_orderstatus", ["F", "O"])

    def run():
        return process_available(read_arriving(spark, source, schema), operator, out, check, 120)

    arrive("a.json", range(6))
    assert run()
    assert spark.read.parquet(out).count() == 4
    arrive("b.json", range(6, 9))
    assert run()
    assert {r[0] for r in spark.read.parquet(out).select("o_orderkey").collect()} == {0, 1, 3, 4, 6, 7}


def test_streaming_durations(spark, tmp_path):
    source = str(tmp_path / "h")
    frame = history(spark)
    frame.write.json(source)
    stream = read_arriving(spark, source, frame.schema)
    assert process_available(stream, durations.durations, str(tmp_path / "o"), str(tmp_path / "c"), 120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).select("cvr", "difference").collect())
    assert got == [(1, 10), (1, 36515), (2, 1), (3, 1)]
