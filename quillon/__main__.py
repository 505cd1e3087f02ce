import sys

from quillon.cli import run

sys.exit(run())
