"""A small data set of our own: three sources, train and test, with their ground truth."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from lodestone.operators.normalize import SOURCE_COLUMNS

_FIRMS = [
    ("Acme Widgets Private Limited", "12 Park Road, Delhi 110001", "India"),
    ("Blue & Green Foods Ltd", "4B Hill St, Mumbai 400001", "India"),
    ("Société Générale d'Eau SARL", "5 bd Voltaire, 75011 Paris", "France"),
    ("Café Liberté SA", "10 r de la Paix, 75002 Paris", "France"),
    ("Northwind Trading Corp", "100 Main St Apt 5, Dallas 75001", "US"),
    ("Contoso Engineering LLC", "7 Elm Ave, Austin 73301", "US"),
    ("Müller Maschinenbau GmbH", "Hauptstr 3, 10115 Berlin", "Germany"),
    ("Straßen und Brücken AG", "Ring 9, 80331 München", "Germany"),
    ("मॉडर्न Traders Pvt Ltd", "Nr Temple, Pune 411001", "India"),
    ('The "Quoted" Co', "1 Back\\slash Ln", "US"),
    ("Harbor-Side Hotel Inc", "22-A Dock Rd, Boston 02101", "US"),
    ("Empty Street Company", "null", "US"),
    ("No Country Services", "8 Lake Dr, Reno 89501", ""),
    ("Lone Atlantis Works", "1 Deep Sq", "Atlantis"),
    ("Twin Tech Labs", "30 Oak Blvd, Miami 33101", "US"),
    ("Lonely Limited", "99 Nowhere Hwy", "France"),
]
_NOISE = [lambda x: x, str.upper, lambda x: x.replace("Private Limited", "Pvt. Ltd.").replace("&", "and"), lambda x: x.replace(" Ltd", "").replace(" SARL", ""), lambda x: x.replace("St", "Street").replace("Rd", "Road").replace("bd", "boulevard")]


def rows(split: str) -> dict[str, list[tuple]]:
    """source1, source2, source3 and ground_truth of a split. The test split has names of its own besides."""
    extra = [("Øresund Skibe A/S", "Havn 4, 2100 København", "Denmark")] if split == "test" else [("Train Only Foods Co", "6 Rail Rd, Agra 282001", "India")]
    firms = [*_FIRMS, *extra]
    s1 = [(f"S1-{i}", *f) for i, f in enumerate(firms)]
    s2 = [(f"S2-{i}", _NOISE[i % 5](n), _NOISE[(i + 4) % 5](a), c) for i, (n, a, c) in enumerate(firms) if i not in (13, 15)]
    s3 = [(f"S3-{i}", _NOISE[(i + 2) % 5](n), a, c if i % 4 else "") for i, (n, a, c) in enumerate(firms) if i % 2 == 0 and i not in (13, 15)]
    s2 += [("S2-900", "Twin Tech Laboratories", "30 Oak Boulevard, Miami 33101", "US"), ("S2-901", "", "12 Park Road, Delhi 110001", "India"), ("S2-902", "Unrelated Bakery", "", "US")]
    known = {x[0] for x in s2 + s3}
    truth = []
    for i in range(len(firms)):
        ids = [x for x in (f"S2-{i}", f"S3-{i}") if x in known]
        ids += ["S2-900"] if i == 14 else []
        ids += ["S3-404"] if i == 5 else []  # no source has it
        truth.append((f"S1-{i}", ",".join(ids)))
    return {"source1": s1, "source2": s2, "source3": s3, "ground_truth": truth}


def write_fixture(spark: SparkSession, paths) -> None:
    """Writes both splits as TSV below paths.data; FileExistsError rather than overwriting."""
    if os.path.exists(paths.data):
        raise FileExistsError(paths.data)
    for split in ("train", "test"):
        os.makedirs(f"{paths.data}/{split}")
        for name, own in rows(split).items():
            if name == "ground_truth" and split == "test":
                continue
            head = SOURCE_COLUMNS if name != "ground_truth" else ["source1_entity_id", "matched_entity_ids"]
            with open(f"{paths.data}/{split}/{split}_{name}.tsv", "w", encoding="utf-8", newline="\n") as f:
                f.writelines("\t".join(r) + "\n" for r in [head, *own])
