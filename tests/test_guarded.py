"""The guarded decision: one broken rule at a time, gates, verifiers and bounds."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrack.operators import guarded as G

D = "a" * 64
REQUEST = "request_id string, upstream_status string, exactness string, subject_sha256 string, total long"
STATE = "request_id string, state_id string, weight long, unresolved boolean"
ACTION = ("request_id string, action_id string, label string, output string, claim_sha256 string, priority int, cost_num long, cost_den long, requires_certificate boolean, property_id string, certificate_id string, digest string, "
          "valid_from long, valid_to long, for_action string, for_subject string, for_claim string, for_property string, verifier_id string, verifier_version string, verified boolean")
LOSS = "request_id string, action_id string, state_id string, loss long"
NAMES = [c.strip().split()[0] for c in ACTION.split(",")]
POLICY = G.Policy(resource=(1, 1), abstain=(9, 1), unresolved=(1, 4), verifier_id="v", verifier_version="1", now=5)


def action(name, **more):
    base = dict.fromkeys(NAMES) | {"action_id": name, "label": "l", "output": "{}", "claim_sha256": D, "priority": 1, "cost_num": 0, "cost_den": 1, "requires_certificate": False}
    return base | more


def certified(name, **more):
    return action(name, requires_certificate=True, property_id="p", certificate_id=f"c-{name}", digest=D, valid_from=1, valid_to=9, for_action=name, for_subject=D, for_claim=D, for_property="p", verifier_id="v", verifier_version="1", verified=True) | more


def case(request=None, states=(("s", 3, False), ("t", 1, False)), actions=(action("x"), action("y")), losses=None):
    full = [(a["action_id"], s[0], 1 if a["action_id"] == "x" else 2) for a in actions for s in states]
    return {"request": [{"upstream_status": "success", "exactness": "exact", "subject_sha256": D, "total": 4} | (request or {})], "states": states, "actions": actions, "losses": full if losses is None else losses}


FULL = [(a, s, 1) for a in "xy" for s in "st"]
CASES = {
    "fine": (case(), "selected", "least_risk"),
    "upstream": (case({"upstream_status": "timeout"}), "abstention", "upstream"),
    "upstream null": (case({"upstream_status": None}), "abstention", "upstream"),
    "approximate": (case({"exactness": "approximate"}), "abstention", "not_exact"),
    "sum": (case({"total": 5}), "invalid", "distribution"),
    "total null": (case({"total": None}), "invalid", "distribution"),
    "no states": (case(states=()), "invalid", "distribution"),
    "weight": (case(states=(("s", -1, False), ("t", 5, False))), "invalid", "state"),
    "same state": (case(states=(("s", 2, False), ("s", 2, False)), losses=[("x", "s", 1), ("y", "s", 1), ("x", "s", 1), ("y", "s", 1)]), "invalid", "state,loss"),
    "same action": (case(actions=(action("x"), action("x"))), "invalid", "action,loss"),
    "label": (case(actions=(action("x", label=""),)), "invalid", "action"),
    "output": (case(actions=(action("x", output=None),)), "invalid", "action"),
    "claim": (case(actions=(action("x", claim_sha256="A" * 64),)), "invalid", "action"),
    "cost": (case(actions=(action("x", cost_num=-1),)), "invalid", "action"),
    "missing loss": (case(losses=FULL[1:]), "invalid", "loss"),
    "extra loss": (case(losses=[*FULL, ("x", "u", 1)]), "invalid", "loss"),
    "loss of another state": (case(losses=[*FULL[1:], ("x", "u", 1)]), "invalid", "loss"),
    "negative loss": (case(losses=[*FULL[1:], ("x", "s", -1)]), "invalid", "loss"),
    "same certificate": (case(actions=(certified("x"), certified("y", certificate_id="c-x"))), "invalid", "certificate_id"),
    "no property": (case(actions=(certified("x", property_id=None),)), "invalid", "binding"),
    "no subject": (case({"subject_sha256": None}, actions=(certified("x"),)), "invalid", "binding"),
    "unresolved": (case(states=(("s", 2, False), ("t", 2, True))), "abstention", "unresolved"),
    "unresolved null": (case(states=(("s", 2, None), ("t", 2, False))), "abstention", "unresolved"),
    "unresolved within": (case(states=(("s", 3, False), ("t", 1, True))), "selected", "least_risk"),
    "no actions": (case(actions=()), "abstention", "no_admissible"),
    "too costly": (case(actions=(action("x", cost_num=2),)), "abstention", "no_admissible"),
    "certified": (case(actions=(certified("x"),)), "selected", "least_risk"),
    **{f"not {c}": (case(actions=(certified("x", **{c: None}),)), "abstention", "no_admissible") for c in ("certificate_id", "digest", "valid_from", "for_action", "for_subject", "for_claim", "for_property", "verifier_id", "verifier_version", "verified")},
    "risk": (case(losses=[(a, s, 9) for a in "xy" for s in "st"]), "abstention", "risk"),
}


def test_rules(spark):
    request, states, actions, losses = [], [], [], []
    for name, (c, _, _) in CASES.items():
        request += [(name, *[r[k] for k in ("upstream_status", "exactness", "subject_sha256", "total")]) for r in c["request"]]
        states += [(name, *s) for s in c["states"]]
        actions += [tuple(a[k] if k != "request_id" else name for k in NAMES) for a in c["actions"]]
        losses += [(name, *x) for x in c["losses"]]
    frames = [spark.createDataFrame(r, s) for r, s in ((request, REQUEST), (states, STATE), (actions, ACTION), (losses, LOSS))]
    got = {r["request_id"]: r for r in G.decide(*frames, POLICY).collect()}
    assert {k: (r["status"], r["reason"]) for k, r in got.items()} == {k: v[1:] for k, v in CASES.items()}
    assert (got["fine"]["action_id"], got["fine"]["best_num"] / got["fine"]["best_den"]) == ("x", 1.0) and got["risk"]["action_id"] is None
    twice = G.decide(frames[0].unionByName(frames[0]), *frames[1:], POLICY).where("request_id = 'fine'").first()
    assert (twice["status"], twice["reason"]) == ("invalid", "request")
    assert G.decide(*[f.where("false") for f in frames], POLICY).count() == 0


def test_policy_bounds():
    for bad in ({"resource": (-1, 1)}, {"abstain": (1, 0)}, {"unresolved": (2, 1)}):
        with pytest.raises(ValueError, match="policy"):
            G.Policy(**bad)


def test_verifiers(spark):
    def picky(frame: pd.DataFrame) -> pd.Series:
        if (frame["output"] == "boom").any():
            raise RuntimeError("boom")
        return frame["output"] == "ok"

    rows = [("a", "p", "ok"), ("b", "p", "boom"), ("c", "p", "no"), ("d", "p", "ok"), ("e", "q", "ok"), ("f", None, "ok"), ("g", "short", "ok"), ("h", "null", "ok")]
    df = spark.createDataFrame(rows, "action_id string, property_id string, output string")
    got = {r["action_id"]: r["verified"] for r in G.verified(df, {"p": picky, "short": lambda f: pd.Series([], dtype=bool), "null": lambda f: pd.Series([None] * len(f))}).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": False, "f": False, "g": False, "h": False}
    assert G.verified(df.where(F.lit(False)), {}).count() == 0
