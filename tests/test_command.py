"""The jobs as commands."""

from __future__ import annotations

import json

import pytest
from helpers import rows

from lakeline.__main__ import main
from lakeline.config import TableTarget, Target
from lakeline.sinks import read_version
from lakeline.sources import read_lines, read_target


@pytest.fixture
def store(tmp_path):
    def describe(name, format, **options):
        file = tmp_path / f"{name}.json"
        schema = options.pop("schema", None)
        path = str(tmp_path / name)
        file.write_text(
            json.dumps({"format": format, "options": {"path": path, **options}, "schema": schema})
        )
        return str(file)

    return describe


def test_text_jobs(spark, tmp_path, folder):
    log = tmp_path / "mail.log"
    line = "Jun 10 08:00:00 mailhost dovecot: imap-login: Login: user=<{}>, method=PLAIN\n"
    log.write_text(line.format("ana") * 3 + line.format("bia"))
    main(["mail-logins", str(log), folder("logins"), "--threshold", "1"])
    assert rows(read_lines(spark, folder("logins"))) == [("ana\t3",)]

    salaries = tmp_path / "salaries.csv"
    salaries.write_text("".join(f'"D,J{i}",X,${i}00000.00,$1.00\n' for i in range(1, 101)))
    main(["salaries", str(salaries), folder("top"), "--top", "1"])
    assert rows(read_lines(spark, folder("top"))) == [('10000000.0\t"D, J100"',)]

    payroll = tmp_path / "payroll.csv"
    payroll.write_text("N;T\n-;-\nA;X\nA;X\nB;X \n")
    main(["payroll", str(payroll), folder("titles"), "--header", "--trim"])
    assert rows(read_lines(spark, folder("titles"))) == [("X\t2",)]


def test_enrolments(spark, tmp_path, store, folder):
    source = tmp_path / "students.csv"
    source.write_text("forma_ingresso;sexo;nome_curso\nSiSU;M;FISICA\nX;F;FISICA\n")
    config = tmp_path / "config.json"
    config.write_text(
        json.dumps(
            {
                "url": "mongodb://example.invalid/",
                "database": "d",
                "collection": "students",
                "delimiter": ";",
                "header": True,
                "inferSchema": True,
                "arquivo_entrada": str(source),
            }
        )
    )
    command = ["enrolments", str(config), "--documents", store("docs", "json")]
    main([*command, "--staging", folder("s")])
    assert rows(spark.read.json(folder("docs", "sexo")).select("sexo", "count")) == [("F", 1), ("M", 1)]
    assert spark.read.json(folder("docs", "students")).count() == 2


def test_questions_about_an_admission(spark, tmp_path, store, folder):
    source = tmp_path / "students.csv"
    source.write_text(
        "forma_ingresso;sexo;nome_curso;intake_date;birth_year\n"
        "SiSU;M;FISICA;2024-02-01;2000\nSiSU;F;LETRAS;2023-02-01;2000\nX;F;FISICA;2024-02-01;2001\n"
    )
    config = tmp_path / "config.json"
    fields = ["url", "database", "collection", "delimiter", "header", "inferSchema", "arquivo_entrada"]
    values = ["mongodb://example.invalid/", "d", "students", ";", True, True, str(source)]
    config.write_text(json.dumps(dict(zip(fields, values, strict=True))))
    period = ["--since", "2024-01-01", "--until", "2025-01-01"]
    asked = ["--admission", "SiSU", "--course", "FISICA", *period]
    main(["enrolments", str(config), "--documents", store("docs", "json"), *asked])
    read = lambda name: rows(spark.read.json(folder("docs", name)))
    assert read("ages") == [(23, 1), (24, 1)] and read("count_in_course") == [(1,)]
    assert read("count_in_period") == [(1,)] and read("top_courses_in_period") == [(1, "FISICA")]
    assert read("sexes_by_admission") == [(1, "F"), (1, "M")]


def test_rejects_are_written_if_asked_for(spark, tmp_path, folder):
    salaries = tmp_path / "salaries.csv"
    salaries.write_text('"D,J1",X,$5.00,$1.00\n"D,J2",X,$none,$1.00\n')
    main(["salaries", str(salaries), folder("top"), "--rejects", folder("rejects")])
    assert rows(read_lines(spark, folder("rejects"))) == [('"D,J2",X,$none,$1.00',)]


def test_lake_updates_by_sensor(spark, tmp_path, store, folder):
    lake = tmp_path / "lake"
    lake.mkdir()
    (lake / "a.csv").write_text(
        "sensor_id,sensor_type,measurement,timestamp\ns1,t,85,2024-09-01 10:00:00\ns1,t,8S,2024-09-01 10:00:00\n"
    )
    table = store("table", "parquet")
    main([
        "lake", str(lake), "--key", "sensor_id", "--key", "sensor_type", "--table", table,
        "--checkpoint", folder("c"), "--option", "maxFilesPerTrigger=1", "--rejects", folder("rejects"),
    ])
    health = read_version(spark, TableTarget.load(table).named("sensor_health"))
    assert rows(health.select("sensor_id", "n", "status")) == [("s1", 1, "ok")]
    assert spark.read.json(folder("rejects")).count() == 1


def test_lake_and_migration(spark, tmp_path, store, folder):
    lake = tmp_path / "lake"
    lake.mkdir()
    (lake / "a.csv").write_text(
        "sensor_type,measurement,timestamp\nt,85,2024-09-01 10:00:00\nt,-1,2024-09-01 10:00:01\n"
    )
    stores = ["--documents", store("docs", "json"), "--table", store("table", "parquet")]
    main(["lake", str(lake), *stores])
    table = TableTarget.load(store("table", "parquet"))
    assert rows(read_target(spark, table.named("sensor_metrics"))) == [(42.0, 1, 85.0)]
    assert spark.read.json(folder("docs", "sensor_health")).first()["n"] == 2

    source = store("lake", "csv", header="true", schema="sensor_type string, measurement double")
    main(["migrate", source, store("copy", "parquet"), *stores])
    assert rows(read_target(spark, Target.load(store("copy", "parquet")))) == [("t", -1.0), ("t", 85.0)]
    assert rows(read_target(spark, table.named("migration_metrics"))) == [(42.0, 1, 85.0)]


def test_unknown_job():
    with pytest.raises(SystemExit):
        main(["nothing"])


def test_names_within_a_store():
    assert TableTarget.jdbc("jdbc:x", "a").named("b").options["dbtable"] == "b"
    assert Target("mongodb", {"collection": "a"}).named("b").options["collection"] == "b"
    assert Target("json", {"path": "/a/"}).named("b").options["path"] == "/a/b"
