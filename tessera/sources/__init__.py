"""The table store: files, manifests and snapshots."""
