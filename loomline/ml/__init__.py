"""Models: isolation forest, classifiers, and mask optimisers."""
