"""DataFrame-to-DataFrame transforms, usable in batch and (unless noted) on streams."""
