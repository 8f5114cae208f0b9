"""Brute-force checks that several tests share."""

from test_minhash import brute_force  # noqa: F401
from test_packing import check as check_packing  # noqa: F401
