"""Part of promolens."""
