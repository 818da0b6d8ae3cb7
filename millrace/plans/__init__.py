"""Named queries of the engine, by area. Importing this registers them all."""

from millrace.plans import calculators, curriculum, evidence, hygiene, learning, ledgers, packing, sources, steps, text, windows  # noqa: F401
