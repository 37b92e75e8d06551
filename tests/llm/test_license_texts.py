"""License bodies and headers are found whole, edited and with other punctuation."""

import random

from chronospan.llm import license_scan


def test_license_texts(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join(f"n{rng.randrange(9999)}" for _ in range(n))
    rows, want = [], set()
    for name, text in license_scan.TEMPLATES.items():
        words = text.split()
        if len(words) < 100:
            rows.append(f"{noise(70)} {text} {noise(50)}")
            want.add((len(rows) - 1, name))
            continue
        for _ in range(3):  # 3 % of the words replaced by others, from any place on, behind comment signs
            own = [w if rng.random() > 0.03 else f"x{rng.randrange(99)}" for w in words]
            lines = "\n".join(" * " + " ".join(own[i : i + 9]) for i in range(0, len(own), 9))
            rows.append(f"{noise(rng.randrange(900))}\n{lines}\n{noise(300)}")
            want.add((len(rows) - 1, name))
    rows += ["so: Released under the MIT License, (see below)", "Released under the BSD License", noise(5000)]
    want.add((len(rows) - 3, "MIT"))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan(docs).collect()}
    assert want <= got
    assert not {d for d, _ in got} - {d for d, _ in want}
    assert {"MIT_text", "BSD-3-Clause_text", "Apache-2.0_text", "Apache-2.0_header", "MPL-2.0_header", "GPL-3.0_text"} <= {n for _, n in got}
