"""Text generators that Python workers import."""


def counting_factory():
    calls = []

    def generate(prompts, sample_idx, temperature, top_p, max_new_tokens):
        calls.append(len(prompts))
        return [f"{len(prompts)}/{i}/{temperature}/{top_p}/{max_new_tokens}" for i in sample_idx]

    return generate


def picky_scorer():
    """Fails on conversations that mention a fault."""

    def score(prompts):
        if any("fault" in p for p in prompts):
            raise RuntimeError("no score")
        return [len(p) for p in prompts]

    return score


def short_factory():
    return lambda prompts, sample_idx, **options: []
