"""Configurations: merged settings, and one configuration for each network to run."""

from __future__ import annotations

from copy import deepcopy


def merged(given: dict, config: dict, section: str = "eval_settings") -> dict:
    """What was given, and the configuration's section for all that was not: None and an empty text count as not given."""
    out = dict(given)
    for key, value in (config.get(section) or {}).items():
        if out.get(key) in (None, ""):
            out[key] = value
    return out


#: Settings that a configuration's name tells, and the mark of each.
NAMED = {"cross_validation_folds": "-cv", "sample_neg_examples_factor": "-nf", "num_reps": "-nr", "cv_seed": "-seed"}


def name_of(settings: dict) -> str:
    """The evaluation settings as part of a name."""
    return "".join(f"{mark}{settings[key]}" for key, mark in NAMED.items() if key in settings)


def generate(settings: dict, networks: dict[str, list[str]], algorithms: list[str] | None = None) -> dict[str, dict]:
    """A configuration by name for each of the settings' networks_to_run: its datasets with their files, the algorithms that
    should run, and the evaluation settings.

    networks gives the files of each known network. An entry names the networks that it adds up; a collection, of one network
    whose files are networks of their own, gives a dataset for each file."""
    chosen = [a for a, s in settings["algs"].items() if (a.lower() in [x.lower() for x in algorithms] if algorithms else (s.get("should_run") or [False])[0] is True)]
    base = {
        "output_settings": {"output_dir": settings["output_dir"]},
        "algs": {a: {**deepcopy(settings["algs"][a]), "should_run": [True]} for a in chosen},
        **{k: deepcopy(settings[k]) for k in ("genesets_to_test", "eval_settings") if settings.get(k)},
    }
    out = {}
    for entry in settings["networks_to_run"]:
        names = entry["names"]
        unknown = [n for n in names if n not in networks]
        if unknown:
            raise ValueError(f"no such network: {unknown[0]}")
        version = entry.get("net_version") or "-".join(names)
        common = {"pos_neg_file": settings["pos_neg_file"], **deepcopy(entry.get("net_settings") or {})}
        if entry.get("network_collection"):
            if len(names) > 1:
                raise ValueError("a collection is of one network")
            files = {f.rsplit("/", 1)[-1].split(".")[0]: f for f in networks[names[0]]}
            datasets = [{"exp_name": f"{settings['exp_name']}-{k}", "net_version": f"{names[0]}/{k}", "net_files": [f], **common} for k, f in files.items()]
        else:
            datasets = [{"exp_name": settings["exp_name"], "net_version": version, "net_files": [f for n in names for f in networks[n]], **common}]
        out[f"{version}{name_of(settings.get('eval_settings') or {})}"] = {"input_settings": {"input_dir": settings["input_dir"], "datasets": datasets}, **deepcopy(base)}
    return out
