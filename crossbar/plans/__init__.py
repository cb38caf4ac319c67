"""Signal expressions and how they are laid out as DataFrame stages."""
