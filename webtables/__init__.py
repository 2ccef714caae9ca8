"""webtables: DataFrame operators that turn crawled pages and raw documents into clean, ranked tables."""

from webtables.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
