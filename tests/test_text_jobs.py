"""Mail logins, salaries and payroll on the small edge-case inputs."""

from __future__ import annotations

from helpers import rows

from lakeline.operators.counting import count_by, having_over, top_k
from lakeline.operators.rows import drop_second_row
from lakeline.plans.mail_logins import login_counts, login_events
from lakeline.plans.payroll import payroll_lines, title_counts, title_of
from lakeline.plans.salaries import parse_salaries, top_salaries

MAIL = (
    "Jun 10 08:00:00 mailhost dovecot: imap-login: Login: user=<ana>, method=PLAIN",
    "Jun 10 08:00:01 mailhost dovecot: imap-login: Aborted login: user=<ana>, method=PLAIN",
    "Jul 10 08:00:02 mailhost dovecot: imap-login: Login: user=<bia>, method=PLAIN",
    "Jun  1 08:00:03 mailhost dovecot: imap-login: Login: user=<bia>, method=PLAIN",
    "Jun 10 08:00:04 mailhost dovecot: imap-login: Login: user=<>, method=PLAIN",
    "Jun dovecot: imap-login: Login",
)


def test_logins(lines):
    good, rejected = login_events(lines(*MAIL))
    assert rows(good) == [("Login:",), ("ana",)]
    assert rows(rejected) == sorted([(MAIL[4],), (MAIL[5],)])


def test_logins_with_padded_days(lines):
    good, rejected = login_events(lines(*MAIL), collapse=True)
    assert rows(good) == [("ana",), ("bia",)]
    assert rejected.count() == 2


def test_login_line_is_stripped_before_it_is_cut(lines):
    good, _ = login_events(lines("\t " + MAIL[0] + " \t"))
    assert rows(good) == [("ana",)]


def test_login_threshold_is_strict_and_ties_are_in_order(lines):
    def login(user):
        return MAIL[0].replace("ana", user)

    log = lines(*[login("b")] * 3, *[login("a")] * 3, *[login("c")] * 2, *[login("d")] * 4)
    assert [tuple(r) for r in login_counts(log, threshold=2).collect()] == [
        ("d", 4),
        ("a", 3),
        ("b", 3),
    ]


SALARIES = (
    "name,title,agency,hired,AnnualSalary,GrossPay",
    '"Doe,Jo",CLERK,A1,01/02/2003,$50000.00,$49000.00',
    '"Roe,Al",CLERK,A1,01/02/2003,$60000.00,',
    "single",
)


def test_salaries(lines):
    good, rejected = parse_salaries(lines(*SALARIES))
    assert rows(good) == [(50000.0, '"Doe, Jo"'), (60000.0, '"Roe, Al"')]
    assert rows(rejected) == [(SALARIES[0],)]


def test_two_tokens_are_enough_for_a_salary(lines):
    good, rejected = parse_salaries(lines("5,x ", "x,5", ","))
    assert rows(good) == [(5.0, "5, x")]
    assert rows(rejected) == [(",",), ("x,5",)]


def test_top_salaries_leave_out_nan(lines):
    text = [f"a,n{i:02d},${i}.0," for i in range(20)]
    found = top_salaries(lines(*text, "z,z,nan,", "z,z,none,")).collect()
    assert [r.salary for r in found] == [19.0, 18.0, 17.0, 16.0, 15.0, 14.0]


def test_top_k_with_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (float("nan"), "c")], "x double, k string")
    assert rows(top_k(df, 5, "x", ["k"])) == [(1.0, "a")]


PAYROLL = "NOME;CARGO\n----;-----\nA;MEDICO\nA;MEDICO\nB;MEDICO\nC;MEDICO    \nD;\n"


def test_payroll(spark, tmp_path, lines):
    file = tmp_path / "payroll.csv"
    file.write_text(PAYROLL)
    counts = title_counts(payroll_lines(spark, str(file)))
    assert rows(counts) == [("", 1), ("CARGO", 1), ("MEDICO", 2), ("MEDICO    ", 1)]
    assert counts.first() == ("MEDICO", 2)
    # Without the drop the rule line is a title of its own.
    assert ("-----", 1) in rows(title_counts(lines(*PAYROLL.splitlines())))


def test_payroll_options(spark, tmp_path):
    file = tmp_path / "payroll.csv"
    file.write_text(PAYROLL)
    counts = title_counts(payroll_lines(spark, str(file), header=True), trim_key=True)
    assert rows(counts) == [("", 1), ("MEDICO", 3)]


def test_short_payroll_lines_are_rejected(lines):
    good, rejected = title_of(lines("A;X;more", "short", "short", ""))
    assert rows(good) == [("X",)]
    assert rows(rejected) == [("",), ("short",)]


def test_drop_second_row_by_key(spark):
    df = spark.createDataFrame([(5, "e"), (3, "c"), (9, "i")], "k int, v string")
    assert rows(drop_second_row(df, "k")) == [(3, "c"), (9, "i")]
    assert rows(drop_second_row(df.where("k = 5"), "k")) == [(5, "e")]
    assert rows(drop_second_row(df.where("k > 9"), "k")) == []


def test_counts_of_nothing(spark):
    empty = spark.createDataFrame([], "k string")
    assert rows(having_over(count_by(empty, "k"), 0)) == []
