"""Run settings as plain dataclasses, read from a nested mapping or a YAML or JSON file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from quarryline.operators.collate import INSTRUCTION, MAX_LENGTH


@dataclass
class Model:
    max_length: int = MAX_LENGTH
    instruction: str = INSTRUCTION
    pad_id: int = 0


@dataclass
class Data:
    train_dataset_pool_path: str = ""
    train_positive_map_path: str = ""
    validation_dataset_pool_path: str = ""
    validation_positive_map_path: str = ""


@dataclass
class Training:
    seed: int = 42
    triplet_margin: float = 1.0
    num_train_epochs: int = 3


@dataclass
class Settings:
    model: Model = field(default_factory=Model)
    data: Data = field(default_factory=Data)
    training: Training = field(default_factory=Training)


def from_mapping(values: dict) -> Settings:
    """Known keys of each section; others, such as those of the model trainer, are passed over.
    An absent instruction is empty, as a run without one has no prefix."""

    def section(kind, name: str):
        given = values.get(name) or {}
        return kind(**{f.name: given[f.name] for f in fields(kind) if f.name in given})

    out = Settings(section(Model, "model"), section(Data, "data"), section(Training, "training"))
    if "model" in values and "instruction" not in (values["model"] or {}):
        out.model.instruction = ""
    return out


def read(path: str) -> Settings:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return from_mapping(json.loads(text))
    import yaml

    return from_mapping(yaml.safe_load(text))
