"""Registry and local store of pinned encoder models (driver side; nothing is downloaded unasked)."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import urllib.request
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import DownloadFailed, ModelNotInstalled, UnknownModel


@dataclass(frozen=True)
class EncoderSpec:
    """What a worker needs to build an encoder; holds no handles, so it can be shipped."""

    model: str
    id: str
    dimensions: int
    max_tokens: int
    languages: str
    size_mb: float
    pooling: str = "mean"
    prefix: str = ""
    engine: str = "onnx"
    license: str = "Apache-2.0"
    revision: str = "main"
    pad_id: int = 0
    token_type_ids: bool = True
    directory: str = ""
    threads: int = 1
    artifacts: tuple = field(default=())

    def path(self, name: str) -> str:
        return os.path.join(self.directory, name)


#: Published models with their size in MB over all files.
REGISTRY = {
    s.model: s
    for s in (
        EncoderSpec("all-MiniLM-L6-v2", "sentence-transformers/all-MiniLM-L6-v2", 384, 256, "English", 90.9),
        EncoderSpec("all-MiniLM-L12-v2", "sentence-transformers/all-MiniLM-L12-v2", 384, 128, "English", 133.6),
        EncoderSpec("paraphrase-MiniLM-L3-v2", "sentence-transformers/paraphrase-MiniLM-L3-v2", 384, 128, "English", 69.5),
        EncoderSpec("multi-qa-MiniLM-L6-cos-v1", "sentence-transformers/multi-qa-MiniLM-L6-cos-v1", 384, 512, "English", 90.9),
        EncoderSpec("paraphrase-multilingual-MiniLM-L12-v2", "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2", 384, 128, "50+ languages", 479.4),
        EncoderSpec("all-mpnet-base-v2", "sentence-transformers/all-mpnet-base-v2", 768, 384, "English", 436.3),
        EncoderSpec("paraphrase-multilingual-mpnet-base-v2", "sentence-transformers/paraphrase-multilingual-mpnet-base-v2", 768, 128, "50+ languages", 1119.2),
        EncoderSpec("bge-small-en-v1.5", "BAAI/bge-small-en-v1.5", 384, 512, "English", 133.8, "cls", license="MIT"),
        EncoderSpec("bge-base-en-v1.5", "BAAI/bge-base-en-v1.5", 768, 512, "English", 436.5, "cls", license="MIT"),
        EncoderSpec("multilingual-e5-small", "intfloat/multilingual-e5-small", 384, 512, "100+ languages", 487.4, prefix="query: ", license="MIT"),
        EncoderSpec("nomic-embed-text-v1.5", "nomic-ai/nomic-embed-text-v1.5", 768, 8192, "English", 548.0, prefix="search_document: "),
        EncoderSpec("jina-embeddings-v2-small-en", "jinaai/jina-embeddings-v2-small-en", 512, 8192, "English", 130.5),
        EncoderSpec("mxbai-embed-large-v1", "mixedbread-ai/mxbai-embed-large-v1", 1024, 512, "English", 1337.6, "cls"),
        EncoderSpec("potion-base-8M", "minishlab/potion-base-8M", 256, 1_000_000, "English", 30.9, engine="static", license="MIT"),
    )
}
DEFAULT_MODEL = "all-MiniLM-L6-v2"


def models(spark: SparkSession, detail: bool = False) -> DataFrame:
    columns = ["model", "dimensions", "max_tokens", "languages", "size_mb"] + (["pooling", "prefix", "engine", "license", "id", "revision"] if detail else [])
    kinds = {"dimensions": "int", "max_tokens": "int", "size_mb": "double"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns)
    return spark.createDataFrame([tuple(getattr(s, c) for c in columns) for s in REGISTRY.values()], schema)


def resolve(model: str | None = None) -> EncoderSpec:
    """A registered model by short name or repository id."""
    wanted = model or DEFAULT_MODEL
    for s in REGISTRY.values():
        if wanted in (s.model, s.id):
            return s
    raise UnknownModel(f"unknown model {wanted!r}; known: {', '.join(REGISTRY)}")


def cache_dir() -> str:
    return os.environ.get("SEMTOPICS_CACHE", os.path.join(os.path.expanduser("~"), ".cache", "semtopics"))


def model_directory(spec: EncoderSpec, directory: str | None = None) -> str:
    return os.path.join(directory or cache_dir(), spec.model, spec.revision)


def _files(spec: EncoderSpec) -> list[str]:
    return ["model.safetensors", "tokenizer.json"] if spec.engine == "static" else ["model.onnx", "tokenizer.json"]


def _pins(directory: str) -> dict:
    pin = Path(directory, "manifest.json")
    return json.loads(pin.read_text()) if pin.exists() else {}


def _sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


def model_status(spark: SparkSession, model: str | None = None, directory: str | None = None) -> DataFrame:
    """file, path, exists, valid, expected_bytes, actual_bytes against the pinned manifest."""
    spec = resolve(model)
    home = model_directory(spec, directory)
    pins, rows = _pins(home), []
    for name in _files(spec):
        path = os.path.join(home, name)
        there = os.path.exists(path)
        pin = pins.get(name, {})
        valid = there and (not pin or (os.path.getsize(path) == pin["bytes"] and _sha256(path) == pin["sha256"]))
        rows.append((name, path, there, valid, pin.get("bytes"), os.path.getsize(path) if there else None))
    return spark.createDataFrame(rows, "file string, path string, exists boolean, valid boolean, expected_bytes long, actual_bytes long")


def model_download(model: str | None = None, directory: str | None = None, timeout: float = 600, base_url: str = "https://huggingface.co") -> str:
    """Fetch a model's files: temporary file beside the target, checked against the pin if there
    is one, then renamed. The first download pins sizes and hashes."""
    spec = resolve(model)
    home = model_directory(spec, directory)
    os.makedirs(home, exist_ok=True)
    pins = _pins(home)
    for name in _files(spec):
        target = os.path.join(home, name)
        if os.path.exists(target) and name in pins and _sha256(target) == pins[name]["sha256"]:
            continue
        remote = f"onnx/{name}" if name.endswith(".onnx") else name
        part = f"{target}.part{os.getpid()}"
        try:
            with urllib.request.urlopen(f"{base_url}/{spec.id}/resolve/{spec.revision}/{remote}", timeout=timeout) as src, open(part, "wb") as out:
                shutil.copyfileobj(src, out)
            pin = {"bytes": os.path.getsize(part), "sha256": _sha256(part)}
            if name in pins and pins[name] != pin:
                raise DownloadFailed(f"{name} differs from its pinned size or hash")
            os.replace(part, target)
            pins[name] = pin
        except OSError as e:
            raise DownloadFailed(f"could not download {name} of {spec.model}: {e}") from e
        finally:
            if os.path.exists(part):
                os.remove(part)
    Path(home, "manifest.json").write_text(json.dumps(pins, indent=1))
    return home


def model_remove(model: str | None = None, directory: str | None = None) -> bool:
    home = model_directory(resolve(model), directory)
    if not os.path.isdir(home):
        return False
    shutil.rmtree(home)
    return True


def cache_size(directory: str | None = None) -> int:
    """Bytes of all stored models."""
    return sum(p.stat().st_size for p in Path(directory or cache_dir()).rglob("*") if p.is_file()) if os.path.isdir(directory or cache_dir()) else 0


def load_model(model: str | None = None, directory: str | None = None, threads: int | str = "auto", verify: bool = True) -> EncoderSpec:
    """Spec of an installed model; workers build the session on first use."""
    from dataclasses import replace

    spec = resolve(model)
    home = model_directory(spec, directory)
    pins = _pins(home)
    for name in _files(spec):
        path = os.path.join(home, name)
        if not os.path.exists(path) or (verify and name in pins and _sha256(path) != pins[name]["sha256"]):
            raise ModelNotInstalled(f"{spec.model} is not installed in {home}; run model_download()")
    return replace(spec, directory=home, threads=min(8, os.cpu_count() or 1) if threads == "auto" else int(threads))


def load_custom(directory: str, name: str, pooling: str | None = None, prefix: str = "", max_tokens: int | None = None) -> EncoderSpec:
    """Spec of any exported model in a local folder, read from its configuration files."""

    def config(*names: str) -> dict:
        for n in names:
            p = Path(directory, n)
            if p.exists():
                return json.loads(p.read_text())
        return {}

    cfg, tok, pool = config("config.json"), config("tokenizer_config.json"), config("1_Pooling/config.json", "pooling.json")
    engine = "static" if Path(directory, "model.safetensors").exists() and not Path(directory, "model.onnx").exists() else "onnx"
    if not Path(directory, "tokenizer.json").exists():
        raise ModelNotInstalled(f"no tokenizer.json in {directory}")
    found = pooling or ("cls" if pool.get("pooling_mode_cls_token") else "mean")
    return EncoderSpec(name, name, int(cfg.get("hidden_size", 0)), int(max_tokens or tok.get("model_max_length") or cfg.get("max_position_embeddings") or 512), "unknown", 0.0, found, prefix, engine, "unknown", "local", int(cfg.get("pad_token_id") or 0), cfg.get("type_vocab_size", 2) > 0, directory)
