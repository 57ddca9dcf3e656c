"""Steps, tokens and memory of training runs over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import CHOICES, RANGES, config_code, range_violations, tokens_per_step, training_steps, vram_mb

# Defaults of a run configuration.
DEFAULTS = {
    "seq_len": 1024, "hidden_size": 768, "layers": 12, "batch_size": 1, "grad_accum": 8, "vocab_size": 32000,
    "adapter": "lora", "epochs": 1,
}
U32_FIELDS = ("seq_len", "hidden_size", "layers", "batch_size", "grad_accum", "vocab_size")


def config_column(configs: list[dict]) -> Column:
    """The caller's configurations as one literal array of structs."""
    names = list(DEFAULTS) + sorted({k for c in configs for k in c if (k in RANGES or k in CHOICES) and k not in DEFAULTS})

    def value(config: dict, name: str) -> Column:
        v = F.lit(config.get(name, DEFAULTS.get(name)))
        if name in CHOICES:
            return v.cast("string")
        return v.cast("bigint" if name in U32_FIELDS else "double")

    structs = [
        F.struct(F.lit(i).alias("config_id"), *[value(c, n).alias(n) for n in names]) for i, c in enumerate(configs)
    ]
    return F.array(*structs)


def run_plan(corpus: DataFrame, configs: list[dict], by: str | None = None, text: str = "text") -> DataFrame:
    """One row per corpus group and configuration.

    The corpus is reduced to one row per value of ``by`` (or one in all) before
    the configurations are unfolded beside it, so nothing is joined. Tokens are
    counted as UTF-8 bytes, cut at the configured length.
    """
    if not configs:
        raise ValueError("no configuration given")
    lengths = sorted({int(c.get("seq_len", DEFAULTS["seq_len"])) for c in configs})
    size = F.octet_length(text)
    totals = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("corpus_tokens")]
    totals += [
        F.coalesce(F.sum(F.least(size, F.lit(n))), F.lit(0)).cast("bigint").alias(f"cut_{n}") for n in lengths]
    grouped = corpus.groupBy(by).agg(*totals) if by else corpus.agg(*totals)
    plan = grouped.select("*", F.explode(config_column(configs)).alias("c"))
    names = [f.name for f in plan.schema["c"].dataType.fields]
    cut = F.coalesce(*[F.when(F.col("c.seq_len") == n, F.col(f"cut_{n}")) for n in lengths])
    plan = plan.select(*([by] if by else []), "rows", "corpus_tokens", cut.alias("used_tokens"), "c.*")
    return plan.select(
        *([by] if by else []), "rows", "corpus_tokens", "used_tokens", *names,
        config_code().alias("code"),
        range_violations([n for n in names if n != "config_id"]).alias("out_of_range"),
        tokens_per_step().alias("tokens_per_step"),
        # Sizing counts whole epochs.
        training_steps("rows", epochs=F.floor("epochs")).alias("steps"),
        vram_mb().alias("vram_mb"),
    )
