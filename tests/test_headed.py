"""Files with preambles and headers whose quoted values hold line ends."""

import csv

import numpy as np

from panelcast.sources.headed import headed_files


def write(path, rows, preamble):
    with open(path, "w", newline="") as f:
        f.write("".join(preamble))
        csv.writer(f, lineterminator="\n").writerows(rows)


def test_quoted_line_ends_over_many_splits(spark, tmp_path):
    """Records come back whole wherever splits cut their files."""
    rng = np.random.default_rng(6)
    pool = ["plain", "two\nlines", 'a "quoted" word', "comma, and\n\nblank line", "", "three\nline\nends", 'end"\n"'.strip(), "x" * 40]
    want = []
    for k in range(3):
        head = ["id", "note, long", "text"] if k < 2 else ["id", "other\nname", "text"]
        rows = [[f"{k}-{i}", *[str(v) for v in rng.choice(pool, 2)]] for i in range(200)]
        write(tmp_path / f"f{k}.csv", [head, *rows], ['about "this file\n', "\n"])
        want += [tuple(v or None for v in r) for r in rows]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = headed_files(spark, str(tmp_path), skip_rows=2)
        got = [tuple(r)[:3] for _, rows in found for r in rows.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [names for names, _ in found] == [["id", "note, long", "text"], ["id", "other\nname", "text"]]

    def key(rows):
        return sorted(tuple(v or "" for v in r) for r in rows)

    assert key(got) == key(want)


def test_event_list_with_a_broken_name(spark, tmp_path):
    """S3: a line end in a column before the numbers does not shift them."""
    from panelcast.operators.clean import EVENT_RENAMES
    from panelcast.sources.extracts import load_event_list
    names = list(EVENT_RENAMES)
    numbers = {"year", "t", "deaths", "damage_usd_thousands", "magnitude"}
    rows = [[str(2000 + i) if EVENT_RENAMES[n] in numbers else "storm\nwith a name, in two lines" for n in names] for i in range(3)]
    write(tmp_path / "events.csv", [names, *rows], [])
    got = load_event_list(spark, str(tmp_path / "events.csv"), "AAA").collect()
    assert sorted(r["t"] for r in got) == [2000, 2001, 2002]
