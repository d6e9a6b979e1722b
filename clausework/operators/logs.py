"""Log writes that cannot fail the work they report on (K5, K6)."""

from __future__ import annotations

import logging
from collections.abc import Callable

LOG = logging.getLogger("clausework")


def written_or_logged(write: Callable[[], None], what: str) -> bool:
    """Run a log write; a failure is reported as a warning.  True when it was written."""
    try:
        write()
        return True
    except Exception as failed:  # noqa: BLE001 - whatever fails here, the work itself is done
        LOG.warning("the %s was not written: %s", what, failed)
        return False
