"""Real models and parsers behind the protocols of :mod:`folioflow.operators.models`.

Each needs a library that is imported when the model is made, in the task that uses it. A
missing library is an error that names it; nothing here loads anything by itself.
"""

from __future__ import annotations

import importlib
import io
from collections.abc import Callable

import numpy as np

from . import models

#: Fixed by the encoder: what stands before a query (and not before a passage).
QUERY_PREFIX = "为这个句子生成表示以用于检索相关文章："


def _library(name: str):
    try:
        return importlib.import_module(name)
    except ModuleNotFoundError as e:
        raise RuntimeError(f"this adapter needs the library {e.name}") from e


class PdfFile(models.PdfParser):
    """Text by pypdf, tables by pdfplumber."""

    def pages(self, data: bytes) -> list[str]:
        return [p.extract_text() or "" for p in _library("pypdf").PdfReader(io.BytesIO(data)).pages]

    def tables(self, data: bytes) -> list[tuple[int, list[list[str]]]]:
        with _library("pdfplumber").open(io.BytesIO(data)) as pdf:
            return [(n, t) for n, page in enumerate(pdf.pages) for t in page.extract_tables()]


def encoder(path: str, device: str = "cpu", length: int = 512, prefix: str = QUERY_PREFIX) -> Callable[[], models.Embedder]:
    """A factory of embedders: the first token's last hidden state, normalised; queries get a prefix."""

    def factory() -> models.Embedder:
        torch, hub = _library("torch"), _library("transformers")
        tokenizer, model = hub.AutoTokenizer.from_pretrained(path), hub.AutoModel.from_pretrained(path).to(device).eval()

        def embed(texts: list[str], is_query: bool = False) -> np.ndarray:
            with torch.no_grad():
                given = tokenizer([(prefix if is_query else "") + t for t in texts], padding=True, truncation=True, max_length=length, return_tensors="pt").to(device)
                return torch.nn.functional.normalize(model(**given).last_hidden_state[:, 0], dim=-1).cpu().numpy()

        return embed

    return factory


def cross_encoder(path: str, device: str = "cpu", length: int = 512) -> Callable[[], models.Reranker]:
    """A factory of rerankers: the raw logit of each (query, text)."""

    def factory() -> models.Reranker:
        torch, hub = _library("torch"), _library("transformers")
        tokenizer, model = hub.AutoTokenizer.from_pretrained(path), hub.AutoModelForSequenceClassification.from_pretrained(path).to(device).eval()

        def score(queries: list[str], texts: list[str]) -> list[float]:
            with torch.no_grad():
                given = tokenizer(list(zip(queries, texts)), padding=True, truncation=True, max_length=length, return_tensors="pt").to(device)
                return model(**given).logits.view(-1).float().cpu().tolist()

        return score

    return factory


def local_generator(path: str, adapter: str | None = None, device: str = "cuda", new_tokens: int = 512, input_tokens: int = 6144) -> Callable[[], models.TextGenerator]:
    """A factory of greedy generators on this machine; over-long prompts keep their first and last tokens."""

    def factory() -> models.TextGenerator:
        torch, hub = _library("torch"), _library("transformers")
        tokenizer = hub.AutoTokenizer.from_pretrained(path)
        model = hub.AutoModelForCausalLM.from_pretrained(path, dtype="auto").to(device)
        model = (_library("peft").PeftModel.from_pretrained(model, adapter) if adapter else model).eval()

        def call(prompt: str) -> str:
            given = tokenizer.apply_chat_template([{"role": "user", "content": prompt}], add_generation_prompt=True, return_tensors="pt", enable_thinking=False).to(device)
            with torch.no_grad():
                out = model.generate(given, max_new_tokens=new_tokens, do_sample=False)
            return tokenizer.decode(out[0][given.shape[1] :], skip_special_tokens=True)

        decode = lambda ids: tokenizer.decode(ids, skip_special_tokens=True)
        return models.bounded(call, input_tokens, lambda text: tokenizer(text)["input_ids"], decode)

    return factory
