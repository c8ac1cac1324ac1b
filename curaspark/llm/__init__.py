"""Training-data operators: tokenising, filtering, deduplicating and packing text at corpus scale.

Nothing outside this folder imports it; it imports nothing from the rest of the package.
"""
