"""Where pixels, boxes and manifests come from."""
