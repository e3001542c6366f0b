import pandas as pd
import pytest

from themeloom.__main__ import main


def single_codes():
    from themeloom.clients import KeywordClient

    return KeywordClient(is_multicode=False)


def read_parts(folder, **options):
    parts = [p for p in sorted(folder.glob("part-*")) if p.stat().st_size]
    return pd.concat([pd.read_csv(p, keep_default_na=False, **options) for p in parts])


def test_three_jobs_from_file_to_file(spark, tmp_path):
    """What a user does: categories, then a codeframe, then the indicator table."""
    data = tmp_path / "responses.csv"
    data.write_text("uuid,liked,disliked\nu1,Price!,the COLOUR\nu2,N/A,price\nu3,???,\nu4,the colour,service\n")
    categories, codeframe, out = tmp_path / "categories", tmp_path / "codeframe", tmp_path / "out"

    main(
        ["generate-categories", str(data), str(categories), "--client", "themeloom.clients:FirstWordClient",
         "--sample-size", "4", "--question", "What?"]
    )
    names = read_parts(categories, header=None)[0].tolist()
    assert sorted(names[:-3]) == ["Price", "Service", "The"]  # the empty answer's theme is a blank line
    assert names[-3:] == ["Other", "Bad response", "Uncategorized"]

    chosen = tmp_path / "chosen.csv"
    chosen.write_text("Price\nColour\nOther\nUncategorized\n")
    build = ["build-codeframe", str(data), str(chosen), str(codeframe), "--client", f"{__name__}:single_codes"]
    main([*build, "--ledger", str(tmp_path / "ledger")])
    frame = read_parts(codeframe)
    assert dict(zip(frame.key, frame.value)) == {"price": "Price", "the colour": "Colour", "service": "Other"}
    with pytest.raises(Exception, match="already exists"):
        main([*build, "--ledger", str(tmp_path / "ledger")])
    main([*build, "--ledger", str(tmp_path / "ledger"), "--overwrite"])

    main(["apply-codeframe", str(data), str(chosen), str(codeframe), str(out)])
    coded = read_parts(out).set_index("uuid").sort_index()
    assert list(coded.columns) == ["liked", "disliked"] + [
        f"{c}_{r}" for r in ("liked", "disliked") for c in ("Price", "Colour", "Other", "Uncategorized")
    ]
    cells = {i: "".join(str(v) or "-" for v in row[2:]) for i, row in coded.astype(str).T.items()}
    assert cells == {"u1": "10000100", "u2": "----1000", "u3": "0001----", "u4": "01000010"}

    main(["apply-codeframe", str(data), str(chosen), str(codeframe), str(tmp_path / "out.parquet")])
    table = spark.read.parquet(str(tmp_path / "out.parquet"))
    assert dict(table.dtypes)["Price_liked"] == "bigint" and table.where("liked is null").count() == 1
    assert table.where("liked = ''").count() == 1  # kept apart, unlike in CSV


def test_multiple_codes(spark, tmp_path):
    data, chosen, codeframe = tmp_path / "r.csv", tmp_path / "c.csv", tmp_path / "k.csv"
    data.write_text("uuid,r\nu1,a\nu2,b\n")
    chosen.write_text("X\nY\nUncategorized\n")
    codeframe.write_text("key,value\na,\"['X', 'Y']\"\nb,['Z']\n")
    main(["apply-codeframe", str(data), str(chosen), str(codeframe), str(tmp_path / "out"), "--multicode"])
    coded = read_parts(tmp_path / "out").sort_values("uuid")
    assert coded.iloc[:, 2:].values.tolist() == [[1, 1, 0], [0, 0, 1]]
