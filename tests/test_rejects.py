import random

from kinloom.functions.statements import parse_line
from kinloom.operators.rejects import load_statements

X = "^^<http://www.w3.example/2001/XMLSchema#"
PARTS = ["_:a", "_:b.c", "<u:p>", "<http://x/é>", "<rel>", "<u:a b>", '"x"', '"a \\"q\\" <u:i> . # b"@en-US', '"a\\q"', '"open', f'"2024-02-29"{X}date>', f'"2023-02-29"{X}date>',
         f'"1\\u0030"{X}integer>', f'"1e5"{X}decimal>', f'"24:00"{X}dateTime>', '"x"@', ".", ". # c <u:i>", "garbage", "\x1f", "\n", ""]


def test_lines_load_as_the_plain_parser_reads_them(spark):
    rng = random.Random(5)
    lines = [(" " * rng.randint(0, 1)).join(["_:s", "<u:p>", rng.choice(PARTS), *rng.sample(PARTS, rng.randint(0, 2)), rng.choice([".", " .", " . # c", ""])]) for _ in range(1500)]
    lines += [None, "", " ", "# c", "  # c", " . ", *PARTS] + lines[:5]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lines)], "line_id bigint, line string, s string").repartition(3)
    got = {r.line_id: tuple(r)[1:] for r in load_statements(df, "line_id", "line").collect()}
    for i, x in enumerate(lines):
        want = parse_line(x)
        if all(v is None for v in want):
            assert i not in got
        else:
            assert (got[i][4] is None) == (want[4] is None) and got[i][:4] == want[:4], x


def test_empty_table(spark):
    assert load_statements(spark.createDataFrame([], "line_id bigint, line string"), "line_id", "line").collect() == []
