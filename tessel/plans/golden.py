"""The self-test: two requests with known features."""

from __future__ import annotations

import json

from tessel.sources.payload import with_features

TOLERANCE = 1e-3
#: Two requests and the features that they must have.
GOLDEN = {
    "legit": (
        {
            "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
            "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]},
            "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25},
            "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23},
            "last_transaction": None,
        },
        [0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.0292, 0.15, 0, 1, 0, 0.15, 0.006],
    ),
    "fraud": (
        {
            "transaction": {"amount": 9505.97, "installments": 10, "requested_at": "2026-03-14T05:15:12Z"},
            "customer": {"avg_amount": 81.28, "tx_count_24h": 20, "known_merchants": ["MERC-008", "MERC-007", "MERC-005"]},
            "merchant": {"id": "MERC-068", "mcc": "7802", "avg_amount": 54.86},
            "terminal": {"is_online": False, "card_present": True, "km_from_home": 952.27},
            "last_transaction": None,
        },
        [0.9506, 0.8333, 1.0, 0.2174, 0.8333, -1, -1, 0.9523, 1.0, 0, 1, 1, 0.75, 0.0055],
    ),
}


def differences(spark) -> list[tuple[str, int, float, float]]:
    """(request, dimension, got, expected) of the features that are off."""
    rows = with_features(spark.createDataFrame([(name, json.dumps(body)) for name, (body, _) in GOLDEN.items()], "name string, body string"))
    return [(r["name"], i, got, want) for r in rows.collect() for i, (got, want) in enumerate(zip(r["vector"], GOLDEN[r["name"]][1], strict=True)) if abs(got - want) > TOLERANCE]
