"""Run-sizing arithmetic and configuration checks as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# u64 arithmetic saturates at its largest value; parameters wrap.
U64_MAX = Decimal(18446744073709551615)
U64_SIZE = Decimal(18446744073709551616)
MIB = 1 << 20
BIG = "decimal(38,0)"

# Allowed range per configuration field, (low, low is allowed,
# high, high is allowed); None is open.
RANGES = {
    "seq_len": (128, True, 32768, True),
    "batch_size": (1, True, 1024, True),
    "grad_accum": (1, True, 4096, True),
    "epochs": (0, False, 100, True),
    "learning_rate": (0, False, 1, True),
    "lora_rank": (1, True, 256, True),
    "lora_alpha": (1, True, 1024, True),
    "lora_dropout": (0, True, 1, False),
    "max_samples": (0, True, None, True),
    "num_workers": (0, True, 16, True),
    "warmup_ratio": (0.0, True, 0.5, True),
}


# The words that a field may hold.
CHOICES = {
    "adapter": ("full", "lora", "qlora"),
    "architecture": ("transformer", "looped_transformer", "mamba"),
    "mode": ("train", "finetune"),
    "device": ("auto", "cuda", "cpu"),
}


def _big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(BIG)


def _product(*factors: Column) -> Column:
    """Product capped at the largest u64; three u32 factors fit 38 digits."""
    out = factors[0]
    for f in factors[1:]:
        out = F.least((out * f).cast(BIG), F.lit(U64_MAX).cast(BIG))
    return out


def tokens_per_step(seq_len="seq_len", batch_size="batch_size", grad_accum="grad_accum") -> Column:
    return _product(_big(seq_len), _big(batch_size), _big(grad_accum))


def training_steps(rows, batch_size="batch_size", grad_accum="grad_accum", epochs="epochs") -> Column:
    """ceil(rows / (batch * accumulation)) * whole epochs; 0 without rows or batch."""
    rows, step = _big(rows), (_big(batch_size) * _big(grad_accum)).cast(BIG)
    return F.when((rows == 0) | (step == 0), F.lit(0).cast(BIG)).otherwise(
        _product(_ceil_div(rows, step), _big(epochs)))


def _ceil_div(a: Column, b: Column) -> Column:
    safe = F.when(b == 0, F.lit(1).cast(BIG)).otherwise(b)
    return ((a - a % safe) / safe + F.when(a % safe > 0, 1).otherwise(0)).cast(BIG)


def vram_mb(adapter="adapter", seq_len="seq_len", hidden_size="hidden_size", layers="layers",
            batch_size="batch_size") -> Column:
    """Planning estimate in MiB: weights 2 bytes, optimiser 16 (2 with an adapter), activations 4."""
    s, h, n, b = _big(seq_len), _big(hidden_size), _big(layers), _big(batch_size)
    small = F.col(adapter).isin("lora", "qlora") if isinstance(adapter, str) else adapter
    params = ((n * 12).cast(BIG) * (h * h).cast(BIG)).cast(BIG) % F.lit(U64_SIZE)
    per_param = F.when(small, F.lit(4)).otherwise(F.lit(18)).cast(BIG)
    activations = (s * b).cast(BIG) * (h * n).cast(BIG)
    total = (params.cast(BIG) * per_param + activations.cast(BIG) * 4).cast(BIG)
    none = (h == 0) | (n == 0) | (s == 0) | (b == 0)
    return F.when(none, F.lit(0).cast(BIG)).otherwise(
        ((total - total % MIB) / F.lit(MIB)).cast(BIG))


def config_code() -> Column:
    """0 when usable; otherwise the first rule that fails (1 to 5)."""
    seq = F.col("seq_len").cast("bigint")
    zero = F.lit(False)
    for name in ("seq_len", "hidden_size", "layers", "batch_size"):
        zero = zero | (F.col(name) == 0)
    return (
        F.when(zero, 1)
        .when(seq.bitwiseAND(seq - 1) != 0, 2)
        .when(F.col("hidden_size") % 8 != 0, 3)
        .when(F.col("grad_accum") == 0, 4)
        .when(F.col("vocab_size") < 256, 5)
        .otherwise(0)
    )


def range_violations(columns: list[str]) -> Column:
    """Names of the given configuration columns whose value is out of range or no known word."""
    broken = []
    for name in columns:
        if name in CHOICES:
            broken.append(F.when(~F.coalesce(F.col(name).isin(*CHOICES[name]), F.lit(False)), F.lit(name)))
        if name not in RANGES:
            continue
        low, low_in, high, high_in = RANGES[name]
        c = F.col(name)
        bad = (c < low) if low_in else (c <= low)
        if high is not None:
            bad = bad | ((c > high) if high_in else (c >= high))
        broken.append(F.when(bad, F.lit(name)))
    if not broken:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*broken))
