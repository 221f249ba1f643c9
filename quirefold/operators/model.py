"""A causal language model of the transformers library as an extractor's model: loaded once a worker, greedy by default.

The library and torch are asked for when a model is loaded, so nothing else needs them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import partial
from pathlib import Path

# Fixed value: the model that is taken where none is named.
DEFAULT_MODEL = "microsoft/Phi-3-mini-4k-instruct"


@dataclass(frozen=True)
class Generation:
    max_new_tokens: int = 256
    do_sample: bool = False
    temperature: float = 0.0
    top_p: float = 1.0
    num_beams: int = 1
    repetition_penalty: float = 1.0

    def arguments(self) -> dict:
        """What the library is given; it wants no sampling settings where nothing is sampled."""
        idle = () if self.do_sample else ("temperature", "top_p")
        return {k: v for k, v in asdict(self).items() if k not in idle}


def model_id(path: str = "MODEL_ID.txt", default: str = DEFAULT_MODEL) -> str:
    """The model named in a text file; the default where there is no such file or it is blank."""
    file = Path(path)
    return (file.read_text(encoding="utf-8").strip() if file.exists() else "") or default


class CausalModel:
    """Called with a prompt (and how to generate), it gives the text that follows, without the prompt and stripped.

    The seed is set anew for each call, so the same prompt has the same answer on any worker and in any retry.
    """

    def __init__(self, name: str, seed: int = 0, cache_dir: str | None = None, libraries: tuple | None = None):
        if libraries is None:
            import torch
            import transformers
        else:
            torch, transformers = libraries
        self.torch, self.seed = torch, seed
        on_gpu = torch.cuda.is_available()
        torch.manual_seed(seed)
        self.tokenizer = transformers.AutoTokenizer.from_pretrained(name, cache_dir=cache_dir, use_fast=True)
        if self.tokenizer.pad_token_id is None and self.tokenizer.eos_token_id is not None:
            self.tokenizer.pad_token = self.tokenizer.eos_token
        self.model = transformers.AutoModelForCausalLM.from_pretrained(name, cache_dir=cache_dir, dtype=torch.float16 if on_gpu else torch.float32, device_map="auto" if on_gpu else None)
        self.model.eval()

    def __call__(self, prompt: str, how: Generation = Generation()) -> str:
        if not isinstance(prompt, str) or not prompt.strip():
            raise ValueError("empty prompt")
        self.torch.manual_seed(self.seed)
        given = {k: v.to(self.model.device) for k, v in self.tokenizer(prompt, return_tensors="pt").items()}
        with self.torch.no_grad():
            ids = self.model.generate(**given, **how.arguments(), pad_token_id=self.tokenizer.pad_token_id, eos_token_id=self.tokenizer.eos_token_id)[0]
        return self.tokenizer.decode(ids[given["input_ids"].shape[-1] :], skip_special_tokens=True).strip()


def loader(name: str | None = None, **settings) -> Callable[[], CausalModel]:
    """What ``run_extractor`` calls once in each worker to have its model."""
    return partial(CausalModel, name or model_id(), **settings)
