from pathlib import Path

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(q) for q in entry.queries().values())


def test_readme_accounts_for_the_unclaimed_numbers():
    coverage = (Path(entry.__file__).parent / "README.md").read_text().partition("## Coverage of the survey")[2]
    assert all(n in coverage for n in "A04 J02 J03 J05 J19 S21 T03 T04 T07 U09 W04 X16".split())
