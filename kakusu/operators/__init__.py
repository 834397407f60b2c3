"""DataFrame operators over texts, JSON bodies, images and annotated corpora."""
